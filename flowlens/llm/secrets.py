"""Secrets in whole texts: fixed shapes, and strings that a tokenizer needs too many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import text_rows, texts_of
from flowlens.llm.vocab import default_path
from flowlens.session import ship

# The base shapes, kinds in this order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: What may be a random string: 20 or more characters of the usual key alphabets.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
PARTS, PART = re.compile(r"[+/_=-]+"), re.compile(r"[^+/_=-]+")
#: Shorter parts have too few tokens for a ratio of their own.
LONG_PART = 16
#: Digests and identifiers are known shapes, not secrets: hexadecimal of a digest's length, UUIDs, numbers, and names made
#: of words (any case, with separators, a number at the end of a word).
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
NAME = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4}[+/_=-]+)*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4}[+/_=-]*")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, by start, then kind. Tests before a search skip texts that can't match."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_random(candidate: str, encoder, least_ratio: float) -> bool:
    """Few characters for each token, in a string that is no known digest, number or name.

    A string of a name's shape is one if its longer parts have as many characters for each token as words have.
    """
    if DIGEST.fullmatch(candidate) or UUID.fullmatch(candidate) or NUMBER.fullmatch(candidate):
        return False

    def dense(x):
        return len(x) < least_ratio * len(encoder.encode_ordinary(x))
    if NAME.fullmatch(candidate) and not any(dense(x) for x in PARTS.split(candidate) if len(x) >= LONG_PART):
        return False
    return dense(candidate)


def random_parts(a: int, text: str, encoder, least_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a candidate that begins at ``a``: all of it, or it without the words at its ends, or
    parts between separators."""
    if is_random(text, encoder, least_ratio):
        return [(a, a + len(text))]
    parts = [(m.start(), m.end()) for m in PART.finditer(text)]
    worded = [bool(NAME.fullmatch(text, x, y)) and not (y - x >= LONG_PART and y - x < least_ratio * len(encoder.encode_ordinary(text[x:y])))
              for x, y in parts]
    inner = [i for i, w in enumerate(worded) if not w]
    if not inner:
        return []
    x, y = parts[inner[0]][0], parts[inner[-1]][1]
    if y - x >= LEAST and is_random(text[x:y], encoder, least_ratio):
        return [(a + x, a + y)]
    return [(a + x, a + y) for x, y in parts if y - x >= LEAST and is_random(text[x:y], encoder, least_ratio)]


def stretches(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans, sorted by start, leave of a candidate, where it is long enough for one."""
    left = []
    for start, _, end in base:
        if start >= b:
            break
        if end > a:
            left.append((a, start))
            a = end
    return [(x, y) for x, y in [*left, (a, b)] if y - x >= LEAST]


def random_spans(text: str, base: list[tuple[int, int, int]], encoder, least_ratio: float) -> list[tuple[int, int, int]]:
    """Random strings outside the base spans."""
    return [(x, 3, y) for m in CANDIDATE.finditer(text) for a, b in stretches(m.start(), m.end(), base)
            for x, y in random_parts(a, text[a:b], encoder, least_ratio)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, least_ratio: float = 2.2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random), one row for each input row, without a shuffle.

    Spans are kind:start:end in code points, end exclusive, of the whole match. ``random`` spans are maximal strings of
    the key alphabets, base spans cut out of them, or their parts between separators, with fewer than ``least_ratio`` characters for each token, apart from known digests, numbers and
    names; they never overlap a base span. A null or empty text has no spans; a null id stays null; repeated rows are
    scanned each; other columns are left aside; an empty table gives an empty one.
    """
    path = vocabulary or default_path("byte_bpe_50k.tiktoken")

    def scan(batches):
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for raw in texts_of(batch):
                text = raw.decode()
                base = base_spans(text)
                more = random_spans(text, base, encoder, least_ratio)
                kinds = [kind for _, kind, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(sorted(base + more)), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return text_rows(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None, least_ratio: float = 2.2,
                   text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with every span of ``scan_secrets`` replaced by ``mark``; overlapping spans by one mark.

    A null text stays null; rows without secrets are not changed; ``length_col``, if there is such a column, becomes the length
    of a changed text.
    """
    path = vocabulary or default_path("byte_bpe_50k.tiktoken")
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    at_length = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(text: str, encoder) -> str:
        base = base_spans(text)
        spans = sorted(base + random_spans(text, base, encoder, least_ratio))
        out, kept = [], 0
        for a, _, b in spans:
            if a >= kept:
                out += [text[kept:a], mark]
            kept = max(kept, b)
        return "".join([*out, text[kept:]]) if spans else text

    def redact(batches):
        encoder = _encoder(path)
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [None if x is None else clean(x, encoder) for x in old]
            columns[at] = pa.array(new, columns[at].type)
            if at_length is not None:
                sizes = columns[at_length]
                columns[at_length] = pa.array([n if x is y or x == y else len(y) for n, x, y in zip(sizes.to_pylist(), old, new, strict=True)], sizes.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
