"""Text, URL and fingerprint columns. Everything here is a built-in Spark expression
except ``nfc``, which has no JVM counterpart and runs as an Arrow UDF on the few
rows that contain combining marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from storyflow import constants as K

# scheme, authority, path, query of a URL reference (RFC 3986, appendix B).
_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def py_round(c: Column, digits: int = 0) -> Column:
    """Half-even rounding after scaling. It differs from rounding the exact binary value only
    where that value lies within one unit of the last place of a tie (2.675 gives 2.68)."""
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def normalize_url(url: Column) -> Column:
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, _URL, 1))
    host = F.lower(F.regexp_extract(u, _URL, 2))
    path = F.regexp_replace(F.regexp_extract(u, _URL, 3), r";[^/]*$", "")
    path = F.regexp_replace(path, r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)

    def decode(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))

    def encode(c: Column) -> Column:
        return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.filter(
        F.transform(
            F.split(F.regexp_extract(u, _URL, 4), "&"),
            lambda p: F.struct(
                decode(F.substring_index(p, "=", 1)).alias("k"),
                F.when(F.instr(p, "=") > 0, decode(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("v"),
            ),
        ),
        lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(K.TRACKING_PARAMS),
    )
    grouped = F.flatten(
        F.transform(
            F.array_distinct(F.transform(pairs, lambda p: p["k"])),
            lambda k: F.filter(pairs, lambda p: p["k"] == k),
        )
    )
    query = F.array_join(F.transform(grouped, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def url_dedup_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(url), r"/+$", ""))


def extract_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^www\.", "")


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition. Every letter below U+0300 is composed already, so rows of such
    letters stay in the JVM and only a null crosses to Python for them."""
    marked = F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), c)
    return F.coalesce(_nfc(marked), c)


def ensure_nfc(df: DataFrame, *cols: str) -> DataFrame:
    """Compose text columns once, at ingestion; later operators rely on it."""
    return df.withColumns({c: nfc(F.col(c)) for c in cols})


def normalize_title(title: Column) -> Column:
    """Lower case, every run of non-word characters becomes one space. Expects NFC."""
    words = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.trim(words)


def title_fingerprint(title: Column) -> Column:
    return F.sha2(normalize_title(title), 256)


def content_fingerprint(title: Column, body: Column, window: int | None = None) -> Column:
    """Hash of the normalised title and the whole body; ``window`` hashes that many leading characters of the body only."""
    text = F.coalesce(body, F.lit(""))
    text = text if window is None else F.substring(text, 1, window)
    return F.sha2(F.concat_ws("||", normalize_title(title), F.trim(F.lower(text))), 256)


def entity_fingerprint(companies: Column, product: Column, event_type: Column) -> Column:
    names = F.array_join(
        F.array_sort(
            F.transform(
                F.filter(F.coalesce(companies, lit_array([]).cast("array<string>")),
                         lambda c: c.isNotNull() & (c != "")),
                lambda c: F.trim(F.lower(c)),
            )
        ),
        "|",
    )
    parts = F.filter(F.array(names, normalize_term(product), normalize_term(event_type)), lambda p: p != "")
    joined = F.array_join(parts, "::")
    return F.when(joined == "", "").otherwise(F.sha2(joined, 256))


def clean_html(c: Column) -> Column:
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"&[a-zA-Z]+;", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def truncate_text(c: Column, limit: int = 500) -> Column:
    head = F.substring(c, 1, limit)
    # 0-based position of the last blank in the head, -1 when there is none.
    last = F.when(F.instr(head, " ") > 0, F.lit(limit) - F.instr(F.reverse(head), " ")).otherwise(-1)
    cut = F.when(last > limit * 0.8, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.regexp_replace(cut, r"[.,;:]+$", ""), F.lit("…"))
    )


def word_count(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def reading_time(c: Column, wpm: int = 238) -> Column:
    return F.greatest(F.lit(1), F.rint(word_count(c) / F.lit(float(wpm))).cast("int"))


# Letters whose compatibility decomposition starts with an ASCII letter, derived from
# the Unicode tables for Latin ranges instead of being listed.
def _ascii_fold() -> tuple[str, str]:
    src, dst = [], []
    for cp in list(range(0xC0, 0x250)) + list(range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_SRC, _FOLD_DST = _ascii_fold()


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.translate(c, _FOLD_SRC, _FOLD_DST), r"[^\x00-\x7F]", "")
    s = F.regexp_replace(F.lower(s), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"[-\s]+", "-"), r"^-+|-+$", "")


def trend_slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_-]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, 100)


def tokens(normalized: Column, stop_words=()) -> Column:
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    out = F.array_distinct(words)
    return F.array_except(out, lit_array(stop_words)) if len(stop_words) else out


def jaccard(a: Column, b: Column) -> Column:
    """Both sides are distinct token arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / total)


def normalize_term(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def hash_bucket(seed: Column, k: int) -> Column:
    """sha256(seed) as one 256-bit integer, modulo k, folded digit by digit."""
    digits = F.split(F.sha2(seed, 256), "")
    return F.aggregate(
        F.filter(digits, lambda d: d != ""),
        F.lit(0).cast("long"),
        lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % k,
    ).cast("int")


def prettify(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def contains_any(text: Column, words) -> Column:
    """Any listed word occurs in the text. Plain substring tests stay in generated code and
    stop at the first hit; an alternation pattern is several times slower on long texts."""
    hit = None
    for w in dict.fromkeys(words):
        one = F.contains(text, F.lit(w))
        hit = one if hit is None else hit | one
    return hit


def contains_any_word(text: Column, words) -> Column:
    escaped = "|".join(_escape(w) for w in words)
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{escaped})(?![\p{{L}}\p{{N}}_])")


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|" else ch for ch in word)


def count_matches(text: Column, words) -> Column:
    """How many of the listed words occur in the text; a sum of plain tests, no lambda."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total
