"""Vectors, match factors, urgency, crawl budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the reference's for equal results.
DEFAULT_WEIGHTS = {"embedding": 0.35, "salary": 0.15, "location": 0.10, "recency": 0.15, "llm": 0.15, "language": 0.10}
LANGUAGE_NAMES = {
    "en": ["english", "inglés", "ingles"], "es": ["spanish", "español", "espanol"], "de": ["german", "deutsch", "alemán", "aleman"],
    "fr": ["french", "français", "francais", "francés", "frances"], "it": ["italian", "italiano"], "ja": ["japanese", "japonés", "japones"],
    "pt": ["portuguese", "português", "portugues"], "nl": ["dutch", "nederlands"], "zh": ["chinese", "mandarin"], "ru": ["russian", "ruso"],
    "ar": ["arabic", "árabe"], "ko": ["korean", "coreano"], "pl": ["polish", "polaco"], "sv": ["swedish", "sueco"],
}
URGENT_PATTERN = r"(?iu)(?U)\b(immediate|immediately|as soon as possible|asap|urgent|sofort|umgehend|dès que possible|au plus vite)\b"
DEADLINE_PATTERN = (
    r"(?i)(?:deadline|apply by|closing date|closes on|frist|date limite|terme)[^\d]{0,15}(\d{1,2}[./ -]\d{1,2}[./ -]\d{2,4}|\d{4}-\d{2}-\d{2})"
)
# End of fixed values.


def rounded(c: Column, digits: int = 2) -> Column:
    """A double from 0 to 1e15 rounded to some decimals by its exact binary value,
    halves to even: 2.675 gives 2.67, as it is stored a little below."""
    scale, unit = 10**digits, F.lit(2**60).cast("decimal(38,0)")
    whole = F.floor(c)
    part = ((c - whole) * float(2**60)).cast("bigint").cast("decimal(20,0)") * F.lit(scale)
    steps = F.floor(part.cast("decimal(38,0)") / unit).cast("bigint")
    steps = F.when(steps * unit > part, steps - 1).otherwise(steps)
    twice = 2 * (part - steps * unit)
    up = (twice > unit) | ((twice == unit) & (steps % 2 == 1))
    return (whole * scale + steps + up.cast("bigint")) / float(scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def embedding_score(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), cosine(a, b))


def _middle(lo: Column, hi: Column) -> Column:
    return (F.coalesce(lo, F.lit(0)) + F.coalesce(F.nullif(hi, F.lit(0)), lo, F.lit(0))) / 2.0


def pay_score(user_lo: Column, user_hi: Column, lo: Column, hi: Column) -> Column:
    user, job = _middle(user_lo, user_hi), _middle(lo, hi)
    ratio = job / F.nullif(user, F.lit(0.0))
    unknown = (user_lo.isNull() & user_hi.isNull()) | (lo.isNull() & hi.isNull()) | (user == 0) | (job == 0)
    return F.when(unknown, 0.5).when(ratio >= 1, 1.0).when(ratio >= 0.8, 0.5 + (ratio - 0.8) * 2.5).otherwise(F.greatest(F.lit(0.0), ratio / 0.8 * 0.5))


def location_score(wanted: Column, location: Column) -> Column:
    low = F.lower(location)
    hit = F.exists(wanted, lambda w: F.contains(low, F.lower(w)) | F.contains(F.lower(w), low))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, 0.5).when(F.coalesce(location, F.lit("")) == "", 0.3).when(hit, 1.0).otherwise(0.0)


def days_old(now: Column, seen: Column) -> Column:
    """Full days gone by, not calendar days."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(seen)) / 86400)


def recency_score(days: Column) -> Column:
    return F.when(days <= 1, 1.0).when(days <= 7, 0.8).when(days <= 14, 0.5).when(days <= 30, 0.3).otherwise(0.1)


def language_score(spoken: Column, code: Column) -> Column:
    low = F.lower(F.trim(code))
    names = F.create_map(*[x for k, v in LANGUAGE_NAMES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    known = F.coalesce(names[low], F.array(low))
    return F.when(F.coalesce(code, F.lit("")) == "", 0.5).when(F.arrays_overlap(known, F.transform(spoken, lambda x: F.lower(x))), 1.0).otherwise(0.2)


def final_score(parts: dict[str, Column], weights: Column | None = None) -> Column:
    """Weighted sum times 100, one decimal. weights: a map column; a missing key has its default."""
    total = F.lit(0.0)
    for name, default in DEFAULT_WEIGHTS.items():
        part = parts.get(name, F.lit(0.5 if name == "language" else 0.0))
        if name == "llm":
            part = F.when(part > 1, part / 100.0).otherwise(part)
        weight = F.lit(default) if weights is None else F.coalesce(weights[name], F.lit(default))
        total = total + weight * part
    return F.bround(total * 100, 1)


def urgency(tier: Column, days: Column, description: Column, policy: Column) -> Column:
    """0 to 100; 0 without a tier (not on the watch list)."""
    text = F.coalesce(description, F.lit(""))
    score = (
        F.when(tier == "A", 30).when(tier == "B", 15).otherwise(0)
        + F.when(days < 2, 15).when(days < 7, 10).otherwise(0)
        + F.when(F.regexp_like(text, F.lit(URGENT_PATTERN)), 20).otherwise(0)
        + F.when(F.regexp_like(text, F.lit(DEADLINE_PATTERN)), 10).otherwise(0)
        - F.when(policy == "portal_only", 10).otherwise(0)
    )
    return F.when(tier.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def page_budget(average: Column, page_size: Column, bootstrapped: Column, cap: int, safety: int = 1) -> Column:
    pages = F.ceil(F.greatest(average, F.lit(1.0)) / page_size) + safety
    return F.when(bootstrapped, F.least(F.greatest(pages, F.lit(1)), F.lit(cap))).otherwise(F.lit(cap)).cast("int")


def should_run(streak: Column, gap_hours: Column, base_hours: float) -> Column:
    """From three empty runs on, wait base * min(2^(streak - 2), 4) hours."""
    wait = base_hours * F.least(F.pow(F.lit(2.0), streak - 2), F.lit(4.0))
    return (streak < 3) | gap_hours.isNull() | (gap_hours >= wait)

