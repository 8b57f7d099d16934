"""Text: decoding, stripping and line splitting with Python's string rules."""

from __future__ import annotations

from forgelens.functions.sql import lit

# The characters Python treats as white space, and its line boundaries.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"  # besides the pair \r\n

BINARY_PROBE_BYTES = 1024


def strip(text: str) -> str:
    return f"btrim({text}, {lit(WHITESPACE)})"


def lstrip(text: str) -> str:
    return f"trim(LEADING {lit(WHITESPACE)} FROM {text})"


def line_parts(text: str) -> str:
    """Pieces between line boundaries; the piece after a final boundary is an empty string."""
    return f"split(replace({text}, '\\r\\n', '\\n'), {lit(LINE_BREAK)}, -1)"


def open_end(parts: str) -> str:
    """1 when the last piece of ``line_parts`` is the empty rest after a final boundary."""
    return f"int(element_at({parts}, -1) = '')"


def line_count(parts: str) -> str:
    return f"bigint(size({parts}) - {open_end(parts)})"


def blank_count(parts: str) -> str:
    return f"bigint(size(filter({parts}, l -> {lstrip('l')} = '')) - {open_end(parts)})"


def lines(text: str) -> str:
    """The lines of a text. The empty rest after a final boundary is no line."""
    marked = f"transform(array({line_parts(text)}), p -> slice(p, 1, size(p) - {open_end('p')}))"
    return f"{marked}[0]"


def is_binary(content: str, sample_bytes: int | None = BINARY_PROBE_BYTES) -> str:
    """A NUL byte in the first bytes, or anywhere for ``None``. Missing content is not binary."""
    sample = content if sample_bytes is None else f"substring({content}, 1, {sample_bytes})"
    return f"coalesce(contains({sample}, X'00'), false)"


# Stands before a letter that says what was there: itself, or a replacement character that the text really holds.
_MARK = "\x01"


def decode_lenient(content: str) -> str:
    """UTF-8 text without the undecodable bytes; missing content gives the empty string.

    Spark puts a replacement character in place of undecodable bytes. Those that stand in the text as they are get a name
    of their own before, and their place back after the others were removed.
    """
    raw = f"cast({content} AS string)"
    named = f"replace(replace({raw}, {lit(_MARK)}, {lit(_MARK + 'm')}), '\ufffd', {lit(_MARK + 'r')})"
    cleaned = f"replace(make_valid_utf8({named}), '\ufffd', '')"
    restored = f"replace(replace({cleaned}, {lit(_MARK + 'r')}, '\ufffd'), {lit(_MARK + 'm')}, {lit(_MARK)})"
    return f"coalesce(if(is_valid_utf8({raw}), {raw}, {restored}), '')"


def read_text(content: str) -> str:
    """Lenient text of a whole file as a text reader gives it: every line end is a line feed.

    Line counts do not need it, as they take all line ends alike.
    """
    return f"replace(replace({decode_lenient(content)}, '\\r\\n', '\\n'), '\\r', '\\n')"


def safe_text(content: str, max_bytes: int | None = None, sample_bytes: int | None = BINARY_PROBE_BYTES) -> str:
    """Text of a file, empty for binary files; optionally of its first bytes, whose line ends stay as they are."""
    body = read_text(content) if max_bytes is None else decode_lenient(f"substring({content}, 1, {max_bytes})")
    return f"if({is_binary(content, sample_bytes)}, '', {body})"


_HASHES = {"md5": "md5({})", "sha1": "sha1({})"}
_HASHES |= {f"sha{bits}": f"sha2({{}}, {bits})" for bits in (224, 256, 384, 512)}


def content_hash(content: str, algorithm: str = "sha256") -> str:
    if algorithm not in _HASHES:
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    return _HASHES[algorithm].format(content)
