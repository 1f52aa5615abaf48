"""Secrets in texts: known shapes, and strings that a tokenizer finds random.

Base kinds, leftmost and without overlap within a kind:
- assign: a key word, a colon or equals sign, and a value of 12 or more characters
- access: AKIA and capitals or digits, 18 or more characters in all
- hex: 16 or more lower-case hexadecimal digits
The added kind:
- random: a string of at least MIN_CHARS letters, digits and + / _ = - that has
  fewer than MAX_RATIO characters per token of a public vocabulary. Texts people
  write have longer tokens. Of a string that has more, the parts between / and =
  are tried, then those between + _ and -, so that words joined to a secret don't
  hide it. Known digests (hexadecimal strings of the usual lengths, object paths),
  UUIDs, numbers and dates are cut out first, wherever they stand in a string.
  Strings without a letter, sequences such as the alphabet, strings of fewer than
  MIN_DISTINCT characters and the content of data URIs are no candidates.

Spans are code points, the end exclusive. Whole texts are read.

Defined cases: a null text is empty and has no spans. Ids may be null or
repeated: each row is judged alone. An empty table stays empty. Other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 12, 18

MIN_CHARS, MAX_RATIO = 20, 2.2
STRING = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
PARTS = tuple(re.compile(rf"[{chars}]{{{MIN_CHARS},}}") for chars in ("A-Za-z0-9+_-", "A-Za-z0-9"))
LETTER = re.compile(r"[A-Za-z]")
HEX_DIGITS = "[0-9a-f]"
#: Known digests, UUIDs, and numbers, dates or versions; each between other characters than letters and digits.
KNOWN = re.compile(
    "(?<![A-Za-z0-9])(?:"
    + "|".join(f"{HEX_DIGITS}{{{n}}}" for n in (32, 40, 48, 56, 64, 96, 128))
    + f"|{HEX_DIGITS}{{2}}/(?:{HEX_DIGITS}{{38}}|{HEX_DIGITS}{{62}})"
    + f"|{HEX_DIGITS}{{8}}(?:-{HEX_DIGITS}{{4}}){{3}}-{HEX_DIGITS}{{12}}"
    + "|[0-9][0-9/_+-]{2,}[0-9]"
    + ")(?![A-Za-z0-9])",
    re.IGNORECASE,
)
DATA_URI = ";base64,"
MIN_DISTINCT = 6

Span = tuple[int, int, int]  # start, kind, end


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> Iterator[Span]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_VALUE:
            yield m.start(), 0, m.end()
    for m in ACCESS.finditer(text):
        if len(m[0]) >= MIN_ACCESS:
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def random_spans(text: str, encode) -> Iterator[Span]:
    for m in STRING.finditer(text):
        if text.endswith(DATA_URI, 0, m.start()):
            continue
        at, found = m.start(), m[0]
        cuts = [k.span() for k in KNOWN.finditer(found)]
        for lo, hi in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(found)]):
            yield from _random_parts(found[lo:hi], at + lo, encode, PARTS)


def _candidate(found: str) -> bool:
    """Long enough, with letters, and neither a sequence (abc, 123) nor of few characters (ACGT)."""
    if len(found) < MIN_CHARS or not LETTER.search(found) or len(set(found)) < MIN_DISTINCT:
        return False
    return 2 * sum(ord(b) - ord(a) in (0, 1) for a, b in zip(found, found[1:])) < len(found)


def _random_parts(found: str, at: int, encode, parts: tuple[re.Pattern, ...]) -> Iterator[Span]:
    """The string, or else those of its parts that are random."""
    if not _candidate(found):
        return
    if len(found) < MAX_RATIO * len(encode(found)):
        yield at, 3, at + len(found)
    elif parts:
        for m in parts[0].finditer(found):
            # a string without the separators is the whole again, which the next ones may cut
            if len(m[0]) < len(found):
                yield from _random_parts(m[0], at + m.start(), encode, parts)
            else:
                yield from _random_parts(m[0], at, encode, parts[1:])


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _scan(path: str):
    def run(batches):
        encode = None
        for batch in batches:
            encode = encode or encoder(path)
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = list(base_spans(text))
                all_ = base + list(random_spans(text, encode))
                kinds = [k for _, k, _ in all_]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), kinds.count(3), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return run


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and all spans, one row per document."""
    return documents(docs).mapInArrow(_scan(vocabulary or default_vocabulary()), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
