"""Text preparation, sanitising, tokens and message chunking as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import as_column
from vigilark.operators.parse import strip

# ---- fixed values: patterns --------------------------------------------------------------
BASIC_PATTERNS = [
    r"```[\s\S]*?```",
    r"`[^`]+`",
    r"(?iU)(ignore|forget|disregard)\s+(all\s+)?(previous|above|prior)\s+"
    r"(instructions?|prompts?|context)",
    r"(?iU)you\s+are\s+now\s+a",
    r"(?iU)system\s*:\s*",
    r"(?iU)assistant\s*:\s*",
    r"(?iU)user\s*:\s*",
    r"(?iU)<\|.*?\|>",
    r"(?iUs)\[INST\].*?\[/INST\]",
    r"(?iUs)<<SYS>>.*?<</SYS>>",
    r"(?iU)<script[\s>][\s\S]*?</script>",
    r"(?iU)<iframe[\s>][\s\S]*?</iframe>",
]
ASCII_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CODE_BLOCK = r"```[\s\S]*?```"
STRICT_PATTERNS = [
    r"(?iU)ignore\s+(all\s+)?previous\s+instructions?",
    r"(?iU)system\s*:",
    r"(?iU)assistant\s*:",
    r"(?iU)user\s*:",
    r"(?iU)<\|?(system|user|assistant|im_start|im_end)\|?>",
    r"(?iU)\[INST\]",
    r"(?iU)\[/INST\]",
    r"(?iU)<<SYS>>",
    r"(?iU)<</SYS>>",
    r"(?iU)you\s+are\s+now\s+(a\s+)?",
    r"(?iU)forget\s+(everything|all)",
    r"(?iU)new\s+instructions?\s*:",
    r"(?iU)override\s+(system|safety)",
    r"(?iU)jailbreak",
    r"(?iU)do\s+not\s+follow\s+(the\s+)?rules?",
    r"(?iU)pretend\s+(you\s+are|to\s+be)",
]
UNICODE_CONTROL = r"[\p{C}&&[^\n\r\t]]"
SANITIZED = "[SANITIZED]"


def wide(pattern: str) -> str:
    """White space and dots as the patterns mean them: U+001C to U+001F are white space, a dot stops at \\n only."""
    pattern = pattern.replace(r"[\s\S]", "(?s:.)").replace(r"[\s", r"[\s\x1c-\x1f")
    pattern = re.sub(r"(?<!\[)\\s", lambda _: r"[\s\x1c-\x1f]", pattern)
    return pattern.replace("(?iU", "(?idU")


def sanitize_basic(text: str | Column, max_chars: int | None = None) -> Column:
    """Replace injected instructions and markup, drop ASCII control characters; cut only if ``max_chars`` is given."""
    clean = as_column(text)
    for pattern in BASIC_PATTERNS:
        clean = F.regexp_replace(clean, wide(pattern), SANITIZED)
    clean = F.regexp_replace(clean, ASCII_CONTROL, "")
    if max_chars is None:
        return clean
    return F.when(F.length(clean) > max_chars,
                  F.concat(F.substring(clean, 1, max_chars), F.lit("...[TRUNCATED]"))).otherwise(clean)


def sanitize_strict(text: str | Column) -> Column:
    """Replace code blocks and injections, drop Unicode control characters, squeeze white space."""
    clean = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), CODE_BLOCK,
                             "[CODE_BLOCK_REMOVED]")
    for pattern in STRICT_PATTERNS:
        clean = F.regexp_replace(clean, wide(pattern), SANITIZED)
    clean = F.regexp_replace(clean, UNICODE_CONTROL, "")
    clean = F.regexp_replace(clean, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(clean, r"[ \t]{4,}", "   "))


def has_injection(text: str | Column) -> Column:
    """True when any injection pattern or a code block occurs; the text is left alone."""
    text = as_column(text)
    found = text.rlike(CODE_BLOCK)
    for pattern in STRICT_PATTERNS:
        found = text.rlike(wide(pattern)) | found
    return F.coalesce(found, F.lit(False))


def truncate_at_sentence(text: str | Column, max_chars: int) -> Column:
    """Text cut at the last sentence end, else the last space, else hard, within ``max_chars``."""
    text = as_column(text)
    head = F.substring(text, 1, max_chars)
    sentence = F.regexp_extract(head, r"(?U)^([\s\S]*[.!?]\s+)", 1)
    words = F.regexp_extract(head, r"^([\s\S]+) ", 1)
    cut = F.when(F.length(sentence) > 0, sentence).when(F.length(words) > 0, words).otherwise(head)
    return F.when(F.length(text) <= max_chars, text).otherwise(strip(cut))


def words(text: str | Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more characters without the stop words."""
    found = F.regexp_extract_all(F.lower(as_column(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    # array_except would drop repeats; a literal list keeps the filter a hash lookup.
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by every pair of neighbours."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(tokens, F.array_compact(pairs))


def _pack(pieces: Column, joiner: str, limit: int, state: Column, split_long) -> Column:
    """Greedy packing of ``pieces`` onto ``state`` (finished chunks, open chunk)."""
    def finish(done: Column, open_chunk: Column) -> Column:
        return F.when(F.length(open_chunk) > 0, F.array_append(done, open_chunk)).otherwise(done)

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(F.length(acc["open"]) > 0,
                        strip(F.concat(acc["open"], F.lit(joiner), piece))).otherwise(piece)
        closed = finish(acc["done"], acc["open"])
        return (
            F.when(F.length(joined) <= limit,
                   F.struct(acc["done"].alias("done"), joined.alias("open")))
            .when(F.length(piece) > limit, split_long(closed, piece))
            .otherwise(F.struct(closed.alias("done"), piece.alias("open")))
        )

    return F.aggregate(pieces, state, step)


def chunk_message(message: str | Column, max_chars: int = dims.MESSAGE_MAX_CHARS,
                  reserve: int = 0) -> Column:
    """Array of chunks: split at blank lines, then lines, then hard, with ``(i/n)`` in front.

    The mark comes on top of ``max_chars`` unless ``reserve`` characters are
    kept free for it.
    """
    message = as_column(message)
    limit = max_chars - reserve
    fresh = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def hard(done: Column, line: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(line) - 1) / limit).cast("int"))
        slices = F.transform(starts, lambda i: F.substring(line, i * limit + 1, F.lit(limit)))
        return F.struct(F.concat(done, slices).alias("done"), F.lit("").alias("open"))

    def by_line(done: Column, section: Column) -> Column:
        state = F.struct(done.alias("done"), F.lit("").alias("open"))
        return _pack(F.split(section, "\n"), "\n", limit, state, hard)

    packed = _pack(F.split(message, "\n\n"), "\n\n", limit, fresh, by_line)
    chunks = F.transform(
        F.array(packed),
        lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"]))
        .otherwise(s["done"]))[0]

    def numbered(found: Column) -> Column:
        marked = F.transform(found, lambda c, i: F.concat(
            F.lit("("), (i + 1).cast("string"), F.lit("/"), F.size(found).cast("string"), F.lit(")\n"), c))
        return F.when(F.size(found) > 1, marked).otherwise(found)

    # The one-element transform binds the chunks, so they are packed once.
    return F.when(F.length(message) <= max_chars, F.array(message)).otherwise(
        F.transform(F.array(chunks), lambda found: numbered(found))[0])
