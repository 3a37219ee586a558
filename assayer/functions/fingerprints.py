"""Hashes of everything that decides the answer to a model call; a record with another hash is stale.

``backend`` is a JSON text of the fields that name a service without secrets (``identity``). Parts that do not
reach a call, such as the reference of a question in plain grading, are left out, so they make no record stale.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import fingerprint


def identity(provider: str, base_url: str | None = None, mock: bool = False) -> str:
    """A back-end's identity; keys and secrets are no part of it."""
    return json.dumps({"base_url": base_url, "mock": mock, "provider": provider}, sort_keys=True)


def _of(protocol: str, backend: str | Column, **parts: Column) -> Column:
    return fingerprint(protocol=F.lit(protocol), backend=F.lit(backend) if isinstance(backend, str) else backend, **parts)


def generation(question_id: Column, category: Column, turns: Column, model: Column, backend: str, temperature: float = 0.7, max_tokens: int = 1024, system: str | None = None) -> Column:
    return _of(
        "generation/2", backend, question_id=question_id, category=category, turns=turns, model=model,
        temperature=F.lit(temperature), max_tokens=F.lit(max_tokens), system=F.lit(system).cast("string"),
    )


def single(question_id: Column, category: Column, judge: Column, backend: str, turn1: Column, turn2: Column) -> Column:
    """``turn1`` and ``turn2``: the messages of both calls."""
    return _of("single/1", backend, question_id=question_id, category=category, judge=judge, turn1=turn1, turn2=turn2)


def pairwise(question_id: Column, category: Column, judge: Column, backend: str, ab: Column, ba: Column) -> Column:
    return _of("pairwise/1", backend, question_id=question_id, category=category, judge=judge, ab=ab, ba=ba)


def reference_single(question_id: Column, category: Column, judge: Column, backend: str, messages: Column) -> Column:
    return _of("reference-single/1", backend, question_id=question_id, category=category, judge=judge, messages=messages)


def reference_pairwise(question_id: Column, category: Column, judge: Column, backend: str, ab: Column, ba: Column) -> Column:
    return _of("reference-pairwise/1", backend, question_id=question_id, category=category, judge=judge, ab=ab, ba=ba)


def translation_source(question_id: Column, category: Column, turns: Column, reference: Column) -> Column:
    """All fields of a question, its reference too, as a translation takes them in."""
    return fingerprint(question_id=question_id, category=category, turns=turns, reference=reference)


def instructions(protocol: str, *templates: str) -> Column:
    """One hash for a protocol's fixed texts."""
    return fingerprint(protocol=F.lit(protocol), templates=F.array(*map(F.lit, templates)))
