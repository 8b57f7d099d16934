"""Secret scan: fixed patterns, and sliding-window Shannon entropy by character class with an allow-list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, each with the least length of what it names, in the order of kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Windows are sought in each longest run of these characters that has a character of each mark."""

    name: str
    characters: str
    marks: tuple[str, ...]
    bits: float  # least entropy of a window, in bits a character


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", "0123456789abcdef", (_DIGIT, "abcdef"), 2.9),
    CharClass("hex upper", "0123456789ABCDEF", (_DIGIT, "ABCDEF"), 2.9),
    CharClass("upper and digit", _UPPER + _DIGIT, (_UPPER, _DIGIT), 3.4),
    CharClass("lower and digit", _LOWER + _DIGIT, (_LOWER, _DIGIT), 3.5),
    CharClass("mixed", _LOWER + _UPPER + _DIGIT + "+/_=-", (_LOWER, _UPPER, _DIGIT), 3.6),
)
#: Whole spans that are no secrets: UUIDs, dates and times, version and file-like names, repeated units, placeholders.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"\d{4}-\d{2}-\d{2}([T_-][0-9-]+)?",
    r"[a-z]+([-_/][a-z0-9]+)+",
    r"(.{1,8}?)\1+.{0,7}",
    r".*(EXAMPLE|example|xxxx|XXXX|0000000|1234567).*",
)
#: Of these, what is no secret as a whole part between = signs either, where separators belong to the class.
IDENTIFIERS = ALLOWED[:3]
#: Before a colon, these name an address and no user.
MAIL_LABEL = re.compile(r"(?i)(?<![A-Za-z0-9])(mailto|e?-?mail|from|to|b?cc|reply-to):$")


@dataclass(frozen=True)
class EntropyScan:
    window: int = 20
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    identifiers: tuple[str, ...] = IDENTIFIERS


class Scanner:
    """Spans (start, kind number, end) of one text, in code points, end exclusive."""

    def __init__(self, how: EntropyScan) -> None:
        self.how = how
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{how.window},}}")
        self.allowed, self.identifiers = (re.compile("|".join(f"(?:{x})" for x in self._numbered(p))) for p in (how.allowed, how.identifiers))
        self.classes = [(re.compile(f"[{re.escape(c.characters)}]{{{how.window},}}"), [set(m) for m in c.marks], c.bits, "-" in c.characters) for c in how.classes]
        self.terms = [0.0] + [n * math.log2(n) for n in range(1, how.window + 1)]

    @staticmethod
    def _numbered(patterns: tuple[str, ...]) -> Iterator[str]:
        """Back references count through the whole alternation."""
        before = 0
        for p in patterns:
            yield re.sub(r"\\(\d)", lambda m, n=before: f"\\{int(m[1]) + n}", p)
            before += re.compile(p).groups

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def windows(self, run: str, bits: float) -> Iterator[tuple[int, int]]:
        """Unions of windows of enough entropy. H = log2 w - sum(c log2 c) / w; a step changes two counts."""
        w, terms, counts = self.how.window, self.terms, {}
        most = (math.log2(w) - bits) * w
        total, begin, end = 0.0, -1, -1
        for i, c in enumerate(run):
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += terms[n + 1] - terms[n]
            if i >= w:
                old = run[i - w]
                n = counts[old]
                counts[old] = n - 1
                total += terms[n - 1] - terms[n]
            if i >= w - 1 and total <= most + 1e-9:
                if begin >= 0 and i - w + 1 > end:
                    yield begin, end
                    begin = -1
                begin = i - w + 1 if begin < 0 else begin
                end = i + 1
        if begin >= 0:
            yield begin, end

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        for m in self.candidate.finditer(text):
            if self._address(text, m):
                continue
            end = -1
            for a, b in sorted(self._spans(m[0])):
                a, b = a + m.start(), b + m.start()
                if any(s <= a and b <= e for s, _, e in base):
                    continue
                if a < end:
                    found[-1] = (found[-1][0], 3, max(b, end))
                else:
                    found.append((a, 3, b))
                end = found[-1][2]
        return found

    def _spans(self, candidate: str) -> Iterator[tuple[int, int]]:
        """Windows of each class in the longest runs of its characters; those of two classes can overlap."""
        for own, marks, bits, separated in self.classes:
            for r in own.finditer(candidate):
                letters = set(r[0])
                if not all(letters & x for x in marks):
                    continue
                for a, b in self.windows(r[0], bits):
                    a, b = a + r.start(), b + r.start()
                    if not self.allowed.fullmatch(candidate, a, b) and not (separated and self._identifier(candidate, a, b)):
                        yield a, b

    def _identifier(self, candidate: str, a: int, b: int) -> bool:
        """The part between = signs that holds most of the span is a name or number of a known form."""
        at = 0
        for part in candidate.split("="):
            if 2 * (min(b, at + len(part)) - max(a, at)) > b - a:
                return self.identifiers.fullmatch(part) is not None
            at += len(part) + 1
        return False

    @staticmethod
    def _address(text: str, m: re.Match) -> bool:
        """Part of a link or of a mail address; what stands as user or password before a host is neither."""
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if before == ":" and m[0].startswith("//"):
            return after != "@"
        if after == "@":
            return before != ":" or MAIL_LABEL.search(text, max(0, m.start() - 12), m.start()) is not None
        return before == "@"

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.entropy(text, base))


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each union of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]


def scan_secrets(documents: DataFrame, how: EntropyScan = EntropyScan(), mark: str = "[SECRET]") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, redacted.

    spans lists kind:start:end by start, then kind; ``redacted`` is the text without its secrets, null when it has
    none. A null text counts as empty and has no spans. Rows are independent: repeated rows and rows without an id are
    treated like any other. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(how)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, listed, texts = [], [], []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                base, spans = scanner.scan(text)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                listed.append(named(spans))
                texts.append(redacted(text, spans, mark) if spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "redacted"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string, redacted string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def without_secrets(documents: DataFrame, how: EntropyScan = EntropyScan(), mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, secrets in the text replaced by the mark, n_chars (if present) counted anew."""

    names = documents.columns
    column = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(how)
        for batch in batches:
            texts = []
            for cell in batch.column("text"):
                text = cell.as_py()
                texts.append(redacted(text, scanner.scan(text)[1], mark) if text else text)
            yield batch.set_column(column, "text", pa.array(texts, pa.string()))

    out = documents.mapInArrow(run, documents.schema)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
