"""Text, label and identifier functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, empty: tuple[str, ...] = ()) -> Column:
    """Trimmed text; null if blank or one of ``empty`` (lower case).  ``none`` is data unless listed."""
    t = F.trim(c.cast("string"))
    out = F.when(t != "", t)
    return F.when(~F.lower(out).isin(*empty), out) if empty else out


def first_of(*columns: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[clean(c) for c in columns])


def qa_label(*names: str) -> tuple[Column, Column]:
    """The first usable label among columns, in lower case, and the name of its column."""
    labels = [F.lower(clean(F.col(n), ("nan", "none"))) for n in names]
    source = F.when(labels[0].isNotNull(), names[0])
    for n, c in zip(names[1:], labels[1:]):
        source = source.when(c.isNotNull(), n)
    return F.coalesce(*labels), source


def truthy(c: Column, words: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def number(c: Column, default: float | None = None) -> Column:
    """A finite number, or the default."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(default).cast("double"))


def alias(c: Column, table: dict[str, str], unknown: Column) -> Column:
    """The standard word for an alias, compared trimmed and in lower case; ``unknown`` for other words."""
    key = F.lower(F.trim(c))
    words = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(words, key), unknown)


#: Decisions that reviewers write into a manifest, and what they mean.
DECISIONS = {
    "accept": "accept",
    "yes": "accept",
    "y": "accept",
    "keep": "accept",
    "approved": "accept",
    "reject": "reject",
    "no": "reject",
    "n": "reject",
    "drop": "reject",
    "rejected": "reject",
}
#: Decisions that a model's triage gives, and what they mean.
TRIAGE = {
    "accept": "accept_candidate",
    "accept_candidate": "accept_candidate",
    "candidate": "accept_candidate",
    "keep": "accept_candidate",
    "approved": "accept_candidate",
    "review": "review",
    "maybe": "review",
    "uncertain": "review",
    "reject": "reject",
    "drop": "reject",
}
SKY_REGIONS = ("large", "medium", "small", "none")


def _word(c: Column) -> Column:
    """Trimmed, in lower case; empty if null or a word for nothing."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(t.isin("nan", "none"), "").otherwise(t)


def decision(c: Column) -> Column:
    """A reviewer's decision; words that are not known pass through."""
    return alias(_word(c), DECISIONS, _word(c))


def triage(c: Column) -> Column:
    """A triage decision; empty for words that are not known, and errors stay."""
    return alias(_word(c), TRIAGE, F.when(_word(c) == "error", "error").otherwise(""))


def sky_region(c: Column) -> Column:
    """The size of the usable sky, or empty."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*SKY_REGIONS), t).otherwise("")


def class_name(c: Column) -> Column:
    """Lower case, trimmed, with single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def slug(c: Column) -> Column:
    """Letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def short_id(length: int, *parts: Column, separator: str = "|") -> Column:
    """The first hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *[p.cast("string") for p in parts]), 256), 1, length)


def type_of_stem(stem: Column, aliases: dict[str, str], inside: bool = False, default: str = "unknown") -> Column:
    """The type whose alias equals or begins the stem (or occurs in it), longest alias first."""
    s = F.lower(stem)
    out = None
    for name in sorted(aliases, key=lambda a: (-len(a), a)):
        hit = s.contains(name) if inside else (s == name) | s.startswith(name + "_") | s.startswith(name + "-")
        out = F.when(hit, aliases[name]) if out is None else out.when(hit, aliases[name])
    return out.otherwise(default) if out is not None else F.lit(default)


def natural_key(c: Column, width: int = 20) -> Column:
    """A key that sorts runs of digits by number: each is padded with zeros to ``width``."""
    marked = F.regexp_replace(F.lower(c), "([0-9]+)", "\x01$1\x01")
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def parent_folder(path: Column) -> Column:
    """The name of the folder that a path lies in; empty for bare names."""
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), "(?:^|/)([^/]+)/[^/]*$", 1)


def int_list(c: Column) -> Column:
    """A JSON list of integers; empty if malformed."""
    return F.coalesce(F.from_json(c, "array<int>"), F.array().cast("array<int>"))


def box_list(c: Column) -> Column:
    """A JSON list of boxes; malformed gives none, and so do boxes without size."""
    boxes = F.coalesce(F.from_json(c, "array<array<int>>"), F.array().cast("array<array<int>>"))
    return F.filter(boxes, lambda b: (F.size(b) == 4) & (F.get(b, F.lit(2)) > 0) & (F.get(b, F.lit(3)) > 0))


def reply_json(c: Column) -> Column:
    """A model's reply without code fences."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^```[a-z]*\\s*", ""), "\\s*```$", "")


def drone_like(model_type: Column | str, name: Column, classes: list[str], target: str = "drone") -> Column:
    """Whether a predicted class counts as the target; text-prompted models always do."""
    kind = F.lit(model_type) if isinstance(model_type, str) else model_type
    key = F.lower(F.trim(name))
    return (kind == "grounding_dino") | F.coalesce(key.isin(*[c.lower().strip() for c in classes]) | (key == target), F.lit(False))


def object_summary(target: Column, distractor: Column, kind: Column) -> Column:
    """What was pasted into an image, in words."""
    return F.when(target & distractor, F.concat(F.lit("drone+"), kind)).when(target, "drone").when(distractor, kind).otherwise("none")
