"""Column expressions that several operators share. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import Window as W


# How known credentials begin.
SECRET_PREFIXES = ("sk-", "sk_", "AIza", "gsk_", "xai-", "ghp_", "github_pat_")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Sum of products of two arrays, in doubles and in order."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a, b) -> Column:
    """Of unit vectors; clamped to 0..2."""
    return F.least(F.greatest(1 - dot(a, b), F.lit(0.0)), F.lit(2.0))


def l2_normalised(a) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(col(a), lambda x: x.cast("double") / norm)).otherwise(col(a).cast("array<double>"))


def sign_bits(a, bits: int = 64) -> Column:
    """A 64-bit hash: bit i is set where component i is positive."""
    masks = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(bits)])
    set_ = F.zip_with(F.slice(col(a), 1, bits), masks, lambda x, m: F.when(x > 0, m).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_, F.lit(0).cast("long"), lambda s, x: F.when(x.isNull(), s).otherwise(s.bitwiseOR(x)))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def round_half_up(x) -> Column:
    return F.floor(col(x) + 0.5)


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def geometric_mean(parts: list[tuple[Column, float]], floor: float = 0.02) -> Column:
    """exp of the weighted mean of logarithms, each value floored."""
    total = sum(w for _, w in parts)
    logs = [F.lit(w) * F.ln(F.greatest(x, F.lit(floor))) for x, w in parts]
    out = logs[0]
    for x in logs[1:]:
        out = out + x
    return F.exp(out / total)


def upper_element(values: Column, numerator: int, denominator: int) -> Column:
    """Element floor(n * numerator / denominator), from 0, of an array once sorted: the upper
    median for 1/2, the upper quartile for 3/4. Not interpolated; null for an empty array."""
    at = F.floor(F.size(values) * numerator / denominator).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.least(at, F.size(values))))


def neutral_percent_rank(group: list[str], order: list[Column]) -> Column:
    """(rank - 1) / (n - 1) within the group, 0.5 where the group has one row."""
    by = W.partitionBy(*group)
    n = F.count(F.lit(1)).over(by)
    return F.when(n == 1, 0.5).otherwise(F.percent_rank().over(by.orderBy(*order)))


def jaccard(a, b) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def circular_distance(a, b, turn: float = 360.0) -> Column:
    d = F.abs(col(a) - col(b)) % turn
    return F.least(d, turn - d)


def interval_iou(a0, a1, b0, b1) -> Column:
    shared = F.greatest(F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)), F.lit(0.0))
    union = (col(a1) - col(a0)) + (col(b1) - col(b0)) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def has_bits(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(F.lit(mask)) != 0


def path_stem(name) -> Column:
    """File name without its last two dot-suffixes."""
    return F.regexp_replace(F.regexp_replace(col(name), r"\.[^.]*$", ""), r"\.[^.]*$", "")


def scrub_secrets(text) -> Column:
    """Values after token, key, secret or password become asterisks."""
    return F.regexp_replace(col(text), r'(?i)\b(token|key|secret|password)(\s*[=:]\s*)"?[A-Za-z0-9_-]{8,}"?', "$1$2***")


def secret_tokens(text) -> Column:
    """Tokens that begin as known credentials do, or are shaped like them: 32 characters or
    more with an upper-case letter and a digit, so that lower-case digests are none."""
    tokens = F.regexp_extract_all(col(text), F.lit(r"[A-Za-z0-9._-]+"), F.lit(0))
    shaped = lambda x: (F.length(x) >= 32) & x.rlike("[A-Z]") & x.rlike("[0-9]")
    begins = rf"^(?:{'|'.join(SECRET_PREFIXES)}).{{5,}}$"
    return F.filter(tokens, lambda x: x.rlike(begins) | shaped(x))


def numbers_in(text) -> Column:
    """The numbers of a text, those that are equal written alike (50 for 50.0 and 50.00)."""
    found = F.regexp_extract_all(col(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x))


def with_bits(flags, clear: int = 0, set_: Column | int = 0) -> Column:
    """Flags with some bits cleared and then others set."""
    more = F.lit(set_) if isinstance(set_, int) else set_
    return col(flags).bitwiseAND(F.lit(~clear)).bitwiseOR(more)


def folded_path(path) -> Column:
    return F.lower(F.regexp_replace(col(path), r"[\\/]+", "/"))


def camera_time(text, offset) -> Column:
    """A camera's date and time and its offset as a timestamp."""
    return F.to_timestamp(F.concat(col(text), col(offset)), "yyyy:MM:dd HH:mm:ssxxx")


def subsecond_ms(x) -> Column:
    """Three digits are milliseconds, fewer are hundredths."""
    return F.when(col(x) >= 100, col(x)).otherwise(col(x) * 10)


def grounded(text, facts) -> Column:
    """Whether every number in the text is among the facts' numbers."""
    return F.size(F.array_except(numbers_in(text), numbers_in(facts))) == 0


def canonical_hash(pairs: list[str]) -> Column:
    """SHA-256 of the columns as JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(pairs))), 256)


def quantised(x, scale: float) -> Column:
    """Signed 8-bit value of x at a scale, clamped."""
    return clamp(F.round(col(x) / scale), -127.0, 127.0).cast("int")


def softmax(values) -> Column:
    """Exponentials and their sum are bound once for each row, not once for each element."""
    top = F.array_max(col(values))
    e = F.transform(col(values), lambda x: F.exp(x - top))
    bound = F.transform(F.array(e), lambda v: F.struct(v.alias("e"), F.aggregate(v, F.lit(0.0), lambda s, y: s + y).alias("t")))
    return F.element_at(F.transform(bound, lambda b: F.transform(b["e"], lambda x: x / b["t"])), 1)
