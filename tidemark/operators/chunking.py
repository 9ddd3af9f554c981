"""Clean, convert and split long texts; every row keeps its whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters, overlap and tokens per chunk, and separators from coarse to fine.
CHUNK_CHARS = 10_000
CHUNK_OVERLAP = 200
CHUNK_TOKENS = 10_000
SEPARATORS = ("\n\n", "\n", " ")

# Named and numbered entities decoded in page text; "&amp;" goes last.
ENTITIES = (
    ("&nbsp;", " "),
    ("&#160;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)

# What is not text in a page.
HIDDEN_BLOCKS = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->")
TAG = r"(?s)<[^>]*>"
BLANKS = r"[ \t\r\n\f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_doc(c: Column | str) -> Column:
    """Escaped line breaks restored, ``#123`` removed, only letters, digits, blank,
    full stop, comma and line break kept."""
    text = F.replace(_col(c), F.lit("\\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(text, "#[0-9]+", ""), r"[^a-zA-Z0-9 .,\n]", "")


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page with blanks collapsed."""
    text = _col(c)
    for block in HIDDEN_BLOCKS:
        text = F.regexp_replace(text, block, " ")
    text = F.regexp_replace(text, TAG, " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _fixed_pieces(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters starting every ``size - overlap``."""
    step = size - overlap
    last = F.greatest(F.length(text) - F.lit(overlap) - F.lit(1), F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / F.lit(step)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size))))


def chunk_chars(df: DataFrame, text_col: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, out: str = "content") -> DataFrame:
    """One row per chunk with ``chunk_index``; neighbouring chunks share ``overlap`` characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    pieces = _fixed_pieces(F.col(text_col), size, overlap)
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(pieces).alias("chunk_index", out))


def _split_after(text: Column, separator: str) -> Column:
    """Pieces that end with the separator, so they concatenate to the text."""
    return F.split(text, f"(?<={separator})", -1)


def _packed(pieces: str, size: int) -> Column:
    """Neighbouring pieces of a column joined greedily up to ``size`` characters; every piece is copied once."""
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("open"), F.lit(0).alias("i"))

    def add(acc: Column, length: Column) -> Column:
        fits = acc["open"] + length <= F.lit(size)
        return F.struct(
            F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
            F.when(fits, acc["open"] + length).otherwise(length).alias("open"), (acc["i"] + 1).alias("i"),
        )

    def joined(acc: Column) -> Column:
        starts, end = acc["starts"], acc["i"]
        return F.transform(starts, lambda s, j: F.array_join(F.slice(F.col(pieces), s + 1, F.coalesce(F.get(starts, j + 1), end) - s), ""))

    packed = F.aggregate(F.transform(pieces, lambda p: F.length(p)), start, add, joined)
    return F.filter(packed, lambda p: p != "")


def chunk_text(df: DataFrame, text_col: str, size: int = CHUNK_CHARS, out: str = "content") -> DataFrame:
    """Separator-aware chunks of at most ``size`` characters.

    Texts break at blank lines, long paragraphs at line breaks, long lines at
    blanks, and only longer words in the middle. Chunks concatenate to the text.
    """

    def refine(pieces: Column, separator: str) -> Column:
        parts = F.transform(
            pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_split_after(p, separator))
        )
        return F.flatten(parts)

    pieces = F.array(F.col(text_col))
    for separator in SEPARATORS:
        pieces = refine(pieces, separator)
    cut = F.flatten(F.transform(pieces, lambda p: F.when((F.length(p) > 0) & (F.length(p) <= size), F.array(p)).otherwise(
        F.coalesce(_fixed_pieces(p, size, 0), F.array().cast("array<string>"))
    )))
    rest = [c for c in df.columns if c != text_col]
    listed = df.where(F.col(text_col).isNotNull()).select(*rest, cut.alias("_pieces"))
    return listed.select(*rest, F.posexplode(_packed("_pieces", size)).alias("chunk_index", out))


def chunk_tokens(df: DataFrame, text_col: str, size: int = CHUNK_TOKENS, out: str = "content") -> DataFrame:
    """Chunks of ``size`` blank-separated tokens, joined by single blanks."""
    tokens = F.filter(F.split(F.col(text_col), BLANKS, -1), lambda t: t != "")
    listed = df.withColumn("_tokens", tokens).where(F.size("_tokens") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("_tokens") - 1) / F.lit(size)).cast("int"))
    pieces = F.transform(starts, lambda i: F.array_join(F.slice("_tokens", i * size + 1, F.lit(size)), " "))
    rest = [c for c in df.columns if c != text_col]
    return listed.select(*rest, F.posexplode(pieces).alias("chunk_index", out))
