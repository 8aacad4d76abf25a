"""Secret scan: fixed patterns, and strings that are new to their surroundings.

Beyond the fixed patterns, a string in a sensitive context (a word like ``secret`` or ``bearer``
shortly before it) is a candidate. It is compressed by zstandard primed with the code around it and
with a dictionary of usual identifiers; the bytes that it adds, per byte of its own, are its
novelty. Names, words and repeated strings compress against what is known; keys do not, and are
reported. What follows a reported string without a break, as the lines of a PEM body do, shares its
context."""

import bisect
import itertools
import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm import common

KINDS = ("assign", "access", "hex", "novel")  # in the order in which equal starts are listed
# fixed values: patterns of the base kinds, each with the length it must reach
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 12, 18, 16, 16

CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_~=-]{15,}")
SENSITIVE = re.compile(
    r"(?<![A-Za-z])(?:secret|token|password|passwd|passphrase|pwd|credentials?|bearer|authorization|signature|salt|jwt"
    r"|(?:api|private|access|account|shared|signing|encryption|ssh|auth)[ _-]?key)(?![A-Za-z])",
    re.ASCII | re.IGNORECASE,
)
CONTEXT = 64  # code points before a candidate in which a sensitive word counts
AROUND = 512  # code points on either side that prime the compressor
GAP = re.compile(r"""[\s"'+\\/,]{0,32}""")  # between strings that belong together
NOVELTY = 0.85  # added bytes per byte
ENTROPY = 0.95  # of a random string's bits, that a long one must add at least
LONG = 32  # code points from which letters and digits are entropy-coded
HELD = 0.95  # of a token's code points, besides a prefix or a separator, make its alphabet
# the alphabets of encodings, smallest first; a token's is the first that holds it
_ALPHABETS = tuple(
    (re.compile(f"[={characters}]+"), math.log2(n) / 8)
    for characters, n in (("0-9A-F", 16), ("0-9a-f", 16), ("A-Z2-7", 32), ("a-z2-7", 32), ("0-9A-Z", 36), ("0-9a-z", 36),
                          ("0-9A-Za-z", 62), ("0-9A-Za-z+/", 64), ("0-9A-Za-z_-", 64), ("0-9A-Za-z+/_~-", 67))
)
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "access account address admin api application argument array async auth authorization await base64 bearer bool "
    "boolean branch buffer build bytes cache callback certificate class client client_id client_secret code column "
    "command commit config configuration connection connection_string const constructor content context controller "
    "cookie count credential credentials data database date debug default delete description development digest "
    "directory document domain element email enable encoding encryption endpoint environment error event example "
    "exception export false field file filename filter float format function group handler header hostname https "
    "identifier image implements import index input instance integer interface internal json key language length "
    "library license list local localhost location login manager message method metadata model module namespace "
    "network null number object option output package parameter parameters parent passphrase password path payload "
    "placeholder platform policy port prefix private process production project property protected protocol public "
    "query reference region register release repository request resource response result return role schema secret "
    "security select self server service session setting settings sha256 signature source space ssh-rsa static status "
    "storage string subscription suffix table target template test timeout timestamp title token true type undefined "
    "update user username value variable vendor version void webhook window workflow xxxxxxxxxxxxxxxx "
)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_RUNS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_HINTS = (*_ASSIGN_HINTS, b"passphrase", b"pwd", b"credential", b"bearer", b"authorization", b"signature",
                  b"salt", b"jwt", b"key")


def novelty(token: str, before: str, after: str) -> float:
    """Compressed bytes that the token adds to what is known, per byte."""
    known = zstandard.ZstdCompressionDict(
        (IDENTIFIERS + after + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    packer = zstandard.ZstdCompressor(19, dict_data=known, write_content_size=False, write_dict_id=False)
    raw = token.encode()
    return (len(packer.compress(raw)) - len(packer.compress(b""))) / len(raw)


def least_novelty(token: str) -> float:
    """Added bytes per byte from which a token counts as random.

    A long one is entropy-coded, so a random one of a small alphabet adds no more than its bits."""
    if len(token) < LONG:
        return NOVELTY
    bytes_each = next(b for pattern, b in _ALPHABETS if sum(map(len, pattern.findall(token))) >= HELD * len(token))
    return min(NOVELTY, ENTROPY * bytes_each)


def scan(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, in code points, by start and kind."""
    low = raw.translate(_LOWER)
    assign = any(h in low for h in _ASSIGN_HINTS)
    access = b"AKIA" in raw
    runs = b"h" * LEAST_HEX in raw.translate(_HEX_RUNS)
    context = assign or any(h in low for h in _CONTEXT_HINTS)
    if not (assign or access or runs or context):
        return []
    text, spans = raw.decode(), []
    if assign:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if access:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if runs:
        spans += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    if context:
        spans += _novel(text, sorted(spans, key=lambda s: s[1]))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _novel(text, base):
    """Candidates near a sensitive word, or right behind a reported one, that do not compress; what the
    base kinds cover is left out."""
    starts = [s for _, s, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max))
    found, done = [], 0
    for word in SENSITIVE.finditer(text):
        at, reach, linked = max(word.end(), done), word.end() + CONTEXT + LEAST_CANDIDATE, False
        while True:
            m = CANDIDATE.match(text, GAP.match(text, at).end()) if linked else None
            if m is None and at < reach and (m := CANDIDATE.search(text, at, reach)):
                m = CANDIDATE.match(text, m.start())  # whole, beyond the reach
            if m is None:
                break
            token, at, linked = m[0], m.end(), False
            done = at
            if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
                continue
            before_end = bisect.bisect_left(starts, m.end())
            if before_end and ends[before_end - 1] > m.start():
                linked = True
                continue
            before, after = text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]
            if novelty(token, before, after) >= least_novelty(token):
                linked = True
                found.append(("novel", m.start(), m.end()))
    return found


def find(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, spans): the secrets of every row as (kind, start, end), by start, then in the order of KINDS.

    Null and empty texts have none; repeated rows and rows without an id stay."""
    rows = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(block):
        texts = common.string_array(block.column("_text")).cast(pa.binary()).to_pylist()
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts]
        return pa.record_batch([block.column("_id"), pa.array(found, span)], ["_id", "spans"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = common.run_arrow(rows, run, f"_id {kind}, spans array<struct<kind:string,start:long,end:long>>", "_text")
    return found.select(F.col("_id").alias(id_col), "spans")
