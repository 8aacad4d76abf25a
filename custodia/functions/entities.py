"""Entity spans: rules and models propose them, one sweep decides between them.

A span is a place in a text with a kind and a score. Six of the nine kinds have rules; the other three
(person names, driver and medical licences) need a model: pass ``recognizer``, see ``plugins``. Where
spans overlap, a character belongs to the longest, then to the one of highest score, so every character
that anything found is masked exactly once; what is covered whole by better spans is no finding.

Only texts that could hold a rule's entity leave the JVM, as Arrow batches. Every rule takes time in
proportion to the text."""

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns, shapes and scores of the kinds
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ENTITY_PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "PHONE_NUMBER": r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b",
    "IP_ADDRESS": r"\b" + _OCTET + r"(?:\." + _OCTET + r"){3}\b",
}
CARD_DIGITS = (13, 19)
CARD_BREAKS = ((4, 8, 12, 16), (4, 10))  # digits after which a card number may be parted
IBAN_LENGTH = (15, 34)
SCORES = {"EMAIL_ADDRESS": 1.0, "CREDIT_CARD": 1.0, "IBAN_CODE": 1.0, "IP_ADDRESS": 0.95, "US_SSN": 0.85, "PHONE_NUMBER": 0.75}
MODEL_SCORE = 0.85

SPANS = "array<struct<start:int,end:int,entity:string,score:double,value:string>>"
_MAY_HOLD = "@|[0-9][ .-]?[0-9]"  # every rule implies it

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_DOMAIN = re.compile(ENTITY_PATTERNS["EMAIL_ADDRESS"].partition("@")[2], re.ASCII)
_PLAIN = [(kind, re.compile(ENTITY_PATTERNS[kind], re.ASCII)) for kind in ("US_SSN", "PHONE_NUMBER", "IP_ADDRESS")]
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*", re.ASCII)
_IBAN_HEAD = re.compile(r"\b[A-Z]{2}[0-9]{2}", re.ASCII)
_IBAN_PART = re.compile(r"[A-Z0-9]+", re.ASCII)


def luhn_ok(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ends_word(text, at):
    return at == len(text) or text[at] not in _WORD


def _emails(text):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _cards(text):
    """Groups of digits that together have a card's length, breaks and check digit, wherever they stand in
    a run of numbers."""
    least, most = CARD_DIGITS
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < least:
            continue
        groups = [m.span() for m in re.compile("[0-9]+").finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            if start and text[start - 1] in _WORD or text[start] not in "123456":
                continue
            size, breaks = 0, []
            for a, end in groups[i : i + 5]:
                size += end - a
                if size > most:
                    break
                if size >= least and not (size == least and text[start] == "1") and _ends_word(text, end):
                    if any(set(breaks) <= set(b) for b in CARD_BREAKS) and luhn_ok(re.sub("[ -]", "", text[start:end])):
                        yield start, end
                breaks.append(size)


def _ibans(text):
    """Words of capitals and digits, parted by blanks after every fourth character at most, that pass."""
    least, most = IBAN_LENGTH
    for head in _IBAN_HEAD.finditer(text):
        value, at = "", head.start()
        while True:
            part = _IBAN_PART.match(text, at, at + most + 1)
            if not part or not _ends_word(text, part.end()):
                break
            value, at = value + part[0], part.end()
            if len(value) > most:
                break
            if len(value) >= least and iban_ok(value):
                yield head.start(), at
            if len(value) % 4 or text[at : at + 1] != " ":
                break
            at += 1


def rule_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all that a rule finds."""
    found = []
    if "@" in text:
        found += [("EMAIL_ADDRESS", *s) for s in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        found += [(kind, *m.span()) for kind, pattern in _PLAIN for m in pattern.finditer(text)]
        found += [("CREDIT_CARD", *s) for s in _cards(text)]
        found += [("IBAN_CODE", *s) for s in _ibans(text)]
    return [(a, b, kind, SCORES[kind]) for kind, a, b in found]


def model_spans(text: str, findings) -> list[tuple[int, int, str, float]]:
    """A model's findings as spans; one without a place counts wherever its value stands as a word, or
    else anywhere."""
    spans = []
    for f in findings or ():
        score = MODEL_SCORE if f["score"] is None else f["score"]
        if f["start"] is not None:
            spans.append((f["start"], f["end"], f["entity"], score))
        elif f["value"]:
            value = re.escape(f["value"])
            places = [*re.finditer(rf"(?<!\w){value}(?!\w)", text)] or re.finditer(value, text)
            spans += [(*m.span(), f["entity"], score) for m in places]
    return [s for s in spans if 0 <= s[0] < s[1] <= len(text)]


def sweep(spans) -> list[tuple[int, int, str, float]]:
    """The spans in order, each cut to what no better one covers: longest, then score, kind and start."""
    starts, kept = [], []
    for start, end, kind, score in sorted(set(spans), key=lambda s: (s[0] - s[1], -s[3], s[2], s[0])):
        at = bisect.bisect_right(starts, start) - 1
        while at >= 0 and kept[at][1] > start:
            start = kept[at][1]
            at = bisect.bisect_right(starts, start) - 1
        if at + 1 < len(starts):
            end = min(end, starts[at + 1])
        if start < end:
            starts.insert(at + 1, start)
            kept.insert(at + 1, (start, end, kind, score))
    return kept


def masked(text: str, spans) -> str:
    """The text with each span replaced by its <KIND> tag: one cut, one join."""
    parts, done = [], 0
    for start, end, kind, _ in spans:
        parts += [text[done:start], f"<{kind}>"]
        done = end
    return "".join([*parts, text[done:]])


def _swept(texts, findings):
    for text, found in zip(texts.to_pylist(), findings.to_pylist() if findings is not None else [None] * len(texts)):
        yield text, sweep(rule_spans(text) + model_spans(text, found)) if text is not None else []


def _functions():
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()),
                               ("score", pa.float64()), ("value", pa.string())]))

    def spans(texts, findings):
        rows = [[(a, b, k, s, text[a:b]) for a, b, k, s in found] for text, found in _swept(texts, findings)]
        names = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(names, r)) for r in row] for row in rows], kind)

    def mask(texts, findings):
        return pa.array([None if text is None else masked(text, found) for text, found in _swept(texts, findings)], pa.string())

    @F.arrow_udf(SPANS)
    def rules_only(texts: pa.Array) -> pa.Array:
        return spans(texts, None)

    @F.arrow_udf(SPANS)
    def with_model(texts: pa.Array, findings: pa.Array) -> pa.Array:
        return spans(texts, findings)

    @F.arrow_udf("string")
    def mask_rules(texts: pa.Array) -> pa.Array:
        return mask(texts, None)

    @F.arrow_udf("string")
    def mask_model(texts: pa.Array, findings: pa.Array) -> pa.Array:
        return mask(texts, findings)

    return rules_only, with_model, mask_rules, mask_model


def detect_entities(text, recognizer=None) -> Column:
    """array<struct<start,end,entity,score,value>> of everything found, in order; places count code points from 0."""
    text = F.col(text) if isinstance(text, str) else text
    rules_only, with_model, _, _ = _functions()
    if recognizer is not None:
        return F.coalesce(with_model(text, recognizer(text)), F.array().cast(SPANS))
    return F.coalesce(rules_only(F.when(text.rlike(_MAY_HOLD), text)), F.array().cast(SPANS))


def mask_entities(df: DataFrame, column="content", recognizer=None) -> DataFrame:
    """Every entity that a rule or the recognizer finds replaced by its <KIND> tag."""
    text = F.col(column)
    _, _, mask_rules, mask_model = _functions()
    if recognizer is not None:
        return df.withColumn(column, mask_model(text, recognizer(text)))
    return df.withColumn(column, F.coalesce(mask_rules(F.when(text.rlike(_MAY_HOLD), text)), text))


def span_table(df: DataFrame, key, text="content", recognizer=None) -> DataFrame:
    """(key, start, end, entity, score, value): a row per finding."""
    found = df.select(F.col(key), detect_entities(text, recognizer).alias("_spans"))
    return found.select(key, F.inline("_spans"))
