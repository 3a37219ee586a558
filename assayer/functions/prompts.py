"""Judge prompts as columns: role split, optional reference block, bracketed rating or verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.verdicts import has_text

RATE = {
    "en": "You grade one answer of an assistant. Explain briefly, then end with a line Rating: [[n]], n from 1 to 10.",
    "ko": "당신은 도우미의 답변 하나를 채점합니다. 짧게 설명한 뒤 마지막 줄에 Rating: [[n]] 형식으로 1에서 10까지의 점수를 쓰세요.",
}
COMPARE = {
    "en": "You compare two assistants. Order must not matter. Explain briefly, then end with [[A]], [[B]] or [[C]] for a tie.",
    "ko": "당신은 두 도우미를 비교합니다. 순서는 중요하지 않습니다. 짧게 설명한 뒤 [[A]], [[B]] 또는 무승부 [[C]]로 끝내세요.",
}
STEPS = " Solve the task yourself first."


def _system(texts: dict[str, str], lang: Column) -> Column:
    return F.when(lang == "ko", texts["ko"]).otherwise(texts["en"])


def _messages(system: Column, user: Column) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user))))


def _block(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>\n"), F.coalesce(text, F.lit("")), F.lit(f"\n</{name}>"))


def _optional(name: str, text: Column) -> Column:
    return F.when(has_text(text), _block(name, text))


def _lines(*parts: Column) -> Column:
    """Parts that are null are left out."""
    return F.concat_ws("\n\n", *parts)


def single(question: Column, answer: Column, lang: Column, reference: Column | None = None) -> Column:
    user = _lines(_optional("reference", F.lit(None).cast("string") if reference is None else reference), _block("question", question), _block("answer", answer))
    return _messages(_system(RATE, lang), user)


def _transcript(side: str, q1: Column, a1: Column, q2: Column, a2: Column) -> Column:
    turns = [(f"user {k}", q, f"Assistant {side}".strip() + f" {k}", a) for k, q, a in ((1, q1, a1), (2, q2, a2))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.coalesce(t, F.lit(""))) for u, q, s, a in turns for n, t in ((u, q), (s, a))))


def multi_single(q1: Column, a1: Column, q2: Column, a2: Column, lang: Column, references: Column | None = None) -> Column:
    """Both turns; blank reference slots are left out."""
    slots = [] if references is None else [_optional(f"reference {k + 1}", F.get(references, F.lit(k))) for k in (0, 1)]
    return _messages(_system(RATE, lang), _lines(*slots, _transcript("", q1, a1, q2, a2)))


def pair(question: Column, a: Column, b: Column, lang: Column, reference: Column | None = None, steps: bool = False) -> Column:
    """A reference wins over step-by-step instructions."""
    system = _system(COMPARE, lang) if reference is not None or not steps else F.concat(_system(COMPARE, lang), F.lit(STEPS))
    parts = [] if reference is None else [_optional("reference", reference)]
    return _messages(system, _lines(*parts, _block("question", question), _block("Assistant A", a), _block("Assistant B", b)))


def multi_pair(q1: Column, q2: Column, a: tuple[Column, Column], b: tuple[Column, Column], lang: Column, references: Column | None = None) -> Column:
    slots = [] if references is None else [_optional(f"reference {k + 1}", F.get(references, F.lit(k))) for k in (0, 1)]
    return _messages(_system(COMPARE, lang), _lines(*slots, _transcript("A", q1, a[0], q2, a[1]), _transcript("B", q1, b[0], q2, b[1])))


def mock_response(messages: Column) -> Column:
    """What the mock judge says to the last user message."""
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]
    both = F.contains(last, F.lit("Assistant A")) & F.contains(last, F.lit("Assistant B"))
    return F.when(both, "Both are alike. [[C]]").otherwise("A helpful answer.\nRating: [[7]]")
