"""Text column functions: calls, chunks, needles, token estimates, patches, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = r"([a-zA-Z_]\w*)\s*\("
BODY_CAP = 32_000
#: English words that make no search needle.
STOP_WORDS = frozenset((
    "the", "this", "that", "with", "from", "have", "been", "were", "will", "would", "could", "should", "there", "their",
    "which", "when", "where", "what", "about", "does", "into", "some", "other", "than", "then", "also", "just", "only",
    "more", "like", "each", "make", "made", "after", "before", "using", "used", "because", "since", "being", "here", "very",
    "description", "result", "results", "expected", "actual", "following", "example", "issue", "error", "problem", "warning",
    "note", "above", "below", "case", "added", "think", "same", "need", "work", "works",
))


def calls(body: Column, own_name: Column) -> Column:
    """Names that the body seems to call: sorted, each once, without its own."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(body, F.lit(CALL), 1), lambda x: x != own_name)))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line feed doesn't begin another line."""
    body = F.regexp_replace(text, "\n\\z", "")
    got = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r\\z", ""))
    return F.when(F.length(text) > 0, got).otherwise(F.array().cast("array<string>"))


def chunks(text: Column, size: int = 40, stride: int = 20) -> Column:
    """Array of struct(chunk_no, content): windows of `size` lines every `stride` lines; windows of blank lines only go."""

    def windows(all_: Column) -> Column:
        last = F.greatest(F.ceil((F.size(all_) - size) / F.lit(float(stride))), F.lit(0)).cast("int")
        got = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_no"), F.array_join(F.slice(all_, i * stride + 1, size), "\n").alias("content")))
        return F.filter(got, lambda c: c["content"].rlike(r"\S"))

    return F.get(F.transform(F.array(lines(text)), windows), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 3).cast("long")


def capped(body: Column, uncapped: bool = False) -> Column:
    return body if uncapped else F.when(F.char_length(body) > BODY_CAP, F.concat(F.substring(body, 1, BODY_CAP), F.lit("..."))).otherwise(body)


def truncated(text: Column, most: int, mark: str = "\n... (truncated)") -> Column:
    """The first `most` characters, with a mark if there were more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def squeezed(query: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(query, r"(?U)\s+", " "))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-sensitive search for any of the fixed strings."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def matching_lines(text: Column, needles: list[str]) -> Column:
    """Array of struct(line, text) of the lines that hold a needle in any case; lines count from 1."""
    low = [n.lower() for n in needles]
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.filter(numbered, lambda x: contains_any(F.lower(x["text"]), low))


def normal_path(path: Column) -> Column:
    """Forward slashes, no white space around, no leading './' or '/'."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+", "")


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return normal_path(F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path))


def path_matches(a: Column, b: Column) -> Column:
    """Equal, or one is a suffix of the other at a component boundary."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def language(path: Column) -> Column:
    """rust, python, javascript or typescript by extension (with case), else null."""
    known = F.create_map(*[F.lit(x) for pair in (("rs", "rust"), ("py", "python"), ("js", "javascript"), ("jsx", "javascript"), ("ts", "typescript"), ("tsx", "typescript")) for x in pair])
    return F.try_element_at(known, F.regexp_extract(path, r"\.([^./]+)$", 1))


def patch_files(patch: Column) -> Column:
    """Distinct target paths of a unified diff, in order."""
    heads = F.filter(F.split(patch, "\n"), lambda x: F.startswith(x, F.lit("+++ b/")))
    return F.filter(F.array_distinct(F.transform(heads, lambda x: normal_path(F.substring(x, 7, 1 << 20)))), lambda p: (p != "") & (p != "dev/null"))


def fenced_diff(output: Column, fallback: bool) -> Column:
    """The lines in the first diff fence (an open fence takes the rest); without one the whole output, or '' if not fallback."""
    inner = F.regexp_extract(output, r"(?s)(?:^|\n)```diff[^\n]*\n(.*?)(?:\n```|\z)", 1)
    found = output.rlike(r"(?s)(?:^|\n)```diff[^\n]*\n")
    return F.when(found, inner).otherwise(output if fallback else F.lit(""))


def needles(query: str) -> list[str]:
    """Search needles of a question: dotted paths (last part first), identifiers, code in backticks, and, when these are few, long words.

    Each of the first three phases stops once there are 20 after an addition, the last at 15; needles differ without case and have 3
    characters or more."""
    text = re.sub(r"\s+", " ", query).strip()
    out: dict[str, str] = {}

    def phase(found, cap: int) -> None:
        for group in found:
            for word in group:
                if len(word) >= 3:
                    out.setdefault(word.lower(), word)
            if len(out) >= cap:
                return

    phase(((p.rsplit(".", 1)[1], p) for p in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+", text)), 20)
    names = re.findall(r"[A-Z][a-zA-Z0-9]{2,}(?:_[a-zA-Z0-9]+)*|[a-z][a-z0-9]*(?:_[a-z0-9]+)+", text)
    phase(((w,) for w in names if w.lower() not in STOP_WORDS), 20)
    phase(((re.sub(r"(?:\(\))+$", "", w),) for w in re.findall(r"`([^`]{3,})`", text)), 20)
    if len(out) < 5:
        words = re.split(r"[^a-z0-9_-]", text.lower())
        phase(((w,) for w in words if len(w) >= 5 and w not in STOP_WORDS), 15)
    return list(out.values())
