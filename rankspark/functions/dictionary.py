"""Dictionary-driven text functions: skills, titles, seniority, places, domains.

A dictionary is a small, user-supplied value (hundreds to a few thousand forms).  It enters
the plan as one constant-folded literal, so every function here is a plain projection: texts
of any number are matched inside the scan stage, with no join and no shuffle.  Exact
look-ups of single names against a dictionary of any size go through
``canonicalize`` instead, which is an equi-join, and texts through ``extract_by_table``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shape import lookup_join, rows_at_most
from . import fixed
from .text import find_all, let, nonblank, nonempty, quote_phrase, tokenize, trim_space, words_array

# A dictionary literal is part of the plan that goes to every task, so its size is checked.
MAX_FORMS = 20_000
# Runs of letters and digits by which a table of forms is met.
GRAM = 3

MENTION_TYPE = "array<struct<canonical:string,matched_alias:string,evidence:string>>"
_FORM_TYPE = "array<struct<canonical:string,anchor:string,pattern:string>>"


@dataclass(frozen=True)
class Skill:
    canonical: str
    category: str | None = None
    aliases: tuple[str, ...] = ()
    related: tuple[str, ...] = ()


@dataclass(frozen=True)
class SkillDictionary:
    """Skills in order; where two skills share a form, the earlier one owns it."""

    skills: tuple[Skill, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if sum(1 + len(s.aliases) for s in self.skills) > MAX_FORMS:
            raise ValueError(f"a skill dictionary may hold at most {MAX_FORMS} forms")

    @classmethod
    def from_records(cls, records: Sequence[dict]) -> SkillDictionary:
        return cls(
            tuple(
                Skill(
                    r["canonical"],
                    r.get("category"),
                    tuple(r.get("aliases") or ()),
                    tuple(r.get("related") or ()),
                )
                for r in records
            )
        )

    @classmethod
    def read_json(cls, path: str) -> SkillDictionary:
        """A JSON list of ``{canonical, category, aliases, related}`` objects."""
        with open(path, encoding="utf-8") as handle:
            return cls.from_records(json.load(handle))

    @classmethod
    def from_frame(cls, frame: DataFrame) -> SkillDictionary:
        """From columns canonical, category, aliases, related, ord; the size is checked first."""
        rows = frame.orderBy("ord").limit(MAX_FORMS + 1).collect()
        return cls.from_records([r.asDict() for r in rows])

    # -- views -------------------------------------------------------------
    def forms(self) -> list[tuple[str, str]]:
        """(form, canonical): longest form first, then dictionary order."""
        pairs = [
            (form.lower(), s.canonical)
            for s in self.skills
            for form in dict.fromkeys((s.canonical, *s.aliases))
        ]
        return sorted(dict.fromkeys(pairs), key=lambda p: -len(p[0]))

    def owners(self) -> dict[str, str]:
        """form -> canonical, the first owner in order."""
        out: dict[str, str] = {}
        for form, canonical in self.forms():
            out.setdefault(form, canonical)
        return out

    def related(self) -> dict[str, list[str]]:
        return {s.canonical: [r.lower() for r in s.related] for s in self.skills}

    def categories(self) -> dict[str, str | None]:
        return {s.canonical: s.category for s in self.skills}

    def token_features(self) -> dict[str, list[tuple[str, float]]]:
        """token -> extra (feature, weight) pairs used by the hashed embedding."""
        related = self.related()
        return {
            form: [
                (canonical, fixed.CANONICAL_WEIGHT),
                *((r, fixed.RELATED_WEIGHT) for r in related.get(canonical, [])),
            ]
            for form, canonical in self.owners().items()
        }

    def form_frame(self, spark: SparkSession) -> DataFrame:
        """form, canonical, ord - one row per form and skill, as ``extract_by_table`` takes them."""
        rows = [(form, canonical, i) for i, (form, canonical) in enumerate(self.forms())]
        return spark.createDataFrame(rows, "form string, canonical string, ord int")

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        """form, canonical, category, ord - one row per form."""
        categories = self.categories()
        rows = [
            (form, canonical, categories.get(canonical), i)
            for i, (form, canonical) in enumerate(self.owners().items())
        ]
        return spark.createDataFrame(
            rows, "form string, canonical string, category string, ord int"
        )


def default_skills() -> SkillDictionary:
    """A small general-purpose sample; bring your own for real work."""
    from importlib.resources import files

    text = (files("rankspark") / "data" / "sample_skills.json").read_text(encoding="utf-8")
    return SkillDictionary.from_records(json.loads(text))


def json_literal(value, ddl: str) -> Column:
    """A nested constant; the optimizer folds it once, at planning time."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def _java_phrase(form: str) -> str:
    return r"\s+".join(re.escape(part) for part in form.split(" "))


def _anchor(form: str) -> str:
    """The longest run of letters or digits: a cheap necessary condition for a match."""
    runs = re.findall(r"[a-z0-9]+", form.lower())
    if not runs:
        raise ValueError(f"a form needs at least one ASCII letter or digit: {form!r}")
    return max(runs, key=len)


def _present(text: Column, anchors: Sequence[str]) -> Column:
    """Which anchors occur as whole runs in the text (one hash-set pass over the text)."""
    runs = find_all(F.lower(text), "[a-z0-9]+")
    return F.array_intersect(words_array(list(dict.fromkeys(anchors))), runs)


# --- skills ------------------------------------------------------------------
def extract_skills(text: Column, dictionary: SkillDictionary, max_skills: int = 40) -> Column:
    """Skills found in free text, as ``array<struct<canonical, matched_alias, evidence>>``.

    Longest form first; a found span is blanked, so "react native" is not also "react"; each
    skill once; evidence is the line (or lines) around the span in the original text.
    """
    forms = dictionary.forms()
    if not forms:
        return F.array().cast(MENTION_TYPE)
    table = json_literal(
        [
            {
                "canonical": canonical,
                "anchor": _anchor(form),
                "pattern": rf"(?i)(?<![a-z0-9]){_java_phrase(form)}(?![a-z0-9])",
            }
            for form, canonical in forms
        ],
        _FORM_TYPE,
    )
    candidates = let(
        _present(F.coalesce(text, F.lit("")), [_anchor(form) for form, _ in forms]),
        lambda hit: F.filter(table, lambda f: F.array_contains(hit, f["anchor"])),
    )
    return _accepted(text, candidates, max_skills)


def _accepted(text: Column, candidates: Column, max_skills: int) -> Column:
    """The fold over candidate forms (canonical, pattern), in order."""
    body = F.coalesce(text, F.lit(""))

    def line_around(at: Column, size: Column) -> Column:
        before = F.substring_index(F.substring(body, F.lit(1), at - 1), "\n", -1)
        span = F.substring(body, at, size)
        after = F.substring_index(F.substring(body, at + size, F.length(body)), "\n", 1)
        return F.substring(trim_space(F.concat(before, span, after)), 1, fixed.EVIDENCE_CHARS)

    def accept(state: Column, form: Column, at: Column, size: Column) -> Column:
        mention = F.struct(
            form["canonical"].alias("canonical"),
            F.substring(body, at, size).alias("matched_alias"),
            line_around(at, size).alias("evidence"),
        )
        blank = F.repeat(F.lit("\u0000"), size)
        return F.struct(
            F.overlay(state["rest"], blank, at, size).alias("rest"),
            F.concat(state["found"], F.array(mention)).alias("found"),
        )

    def step(state: Column, form: Column) -> Column:
        taken = (F.size(state["found"]) >= max_skills) | F.exists(
            state["found"], lambda m: m["canonical"] == form["canonical"]
        )
        return F.when(taken, state).otherwise(
            let(
                F.regexp_instr(state["rest"], form["pattern"]),
                lambda at: F.when(at == 0, state).otherwise(
                    let(
                        F.length(F.regexp_substr(state["rest"], form["pattern"])),
                        lambda size: accept(state, form, at, size),
                    )
                ),
            )
        )

    start = F.struct(body.alias("rest"), F.array().cast(MENTION_TYPE).alias("found"))
    return F.aggregate(candidates, start, step, lambda state: state["found"])


def form_table(forms: DataFrame) -> DataFrame:
    """gram, rank, canonical, pattern of forms (form, canonical, ord) in a table of any size.

    ``gram`` is a form's first GRAM runs of letters and digits: they stand one after the other in
    every text that holds the form.  ``rank`` puts longer forms first, then goes by ``ord``.
    """
    form = F.lower("form")
    runs = find_all(form, "[a-z0-9]+")
    gram = F.when(
        F.size(runs) == 0, F.raise_error(F.concat(F.lit("a form needs at least one ASCII letter or digit: "), form))
    ).otherwise(F.array_join(F.slice(runs, 1, GRAM), " "))
    escaped = F.regexp_replace(form, r"(\p{Punct})", r"\\$1")
    phrase = F.replace(escaped, F.lit(" "), F.lit(r"\s+"))
    return forms.where(F.col("form").isNotNull()).select(
        gram.alias("gram"), F.struct((-F.length(form)).alias("shorter"), F.col("ord").cast("bigint").alias("ord")).alias("rank"),
        "canonical", F.concat(F.lit("(?i)(?<![a-z0-9])"), phrase, F.lit("(?![a-z0-9])")).alias("pattern"))


def _grams(text: Column) -> Column:
    """All sequences of one to GRAM runs of a text, each once."""

    def joined(runs: Column) -> Column:
        size, out = F.size(runs), runs
        every = [runs]
        for n in range(1, GRAM):
            left = F.greatest(size - n, F.lit(0))
            out = F.zip_with(F.slice(out, F.lit(1), left), F.slice(runs, F.lit(n + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
            every.append(out)
        return F.array_distinct(F.concat(*every))

    return let(find_all(F.lower(F.coalesce(text, F.lit(""))), "[a-z0-9]+"), joined)


def extract_by_table(
    rows: DataFrame, forms: DataFrame, max_skills: int = 40, key: str = "id", text: str = "text", out: str = "mentions"
) -> DataFrame:
    """``extract_skills`` with the forms (form, canonical, ord) as a table: nothing of them is in the plan.

    The grams of the texts meet the forms' in an equi-join; only the forms met go back to their text,
    where the same fold decides.  Counted, few forms travel to the grams, which are then not shuffled;
    the grams, a multiple of the texts, are never broadcast.  Rows with one key share their
    candidates, which changes nothing for any of them; rows without a key have no mentions.
    """
    table = form_table(forms)
    grams = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.explode(_grams(F.col(text))).alias("gram"))
    met = lookup_join(grams, table, ["gram"], rows_at_most(forms), spread_by="_key").groupBy("_key").agg(
        F.array_sort(F.collect_set(F.struct("rank", "canonical", "pattern"))).alias("_forms"))
    none = F.array().cast("array<struct<rank:struct<shorter:int,ord:bigint>,canonical:string,pattern:string>>")
    joined = rows.join(met, F.col(key) == F.col("_key"), "left").drop("_key")
    found = _accepted(F.col(text), F.coalesce("_forms", none), max_skills)
    return joined.withColumn(out, found).drop("_forms")


def expand_skills(names: Column, dictionary: SkillDictionary) -> Column:
    """Names plus their related skills, order kept.

    A name that already appeared as somebody's relative does not bring its own relatives.
    """
    related = json_literal(dictionary.related(), "map<string,array<string>>")
    return F.aggregate(
        names,
        F.array().cast("array<string>"),
        lambda acc, n: F.when(F.array_contains(acc, n), acc).otherwise(
            F.array_union(
                acc,
                F.concat(
                    F.array(n),
                    F.coalesce(F.try_element_at(related, n), F.array().cast("array<string>")),
                ),
            )
        ),
    )


def canonical_of(name: Column, dictionary: SkillDictionary) -> Column:
    """Exact look-up of one name, inside a projection."""
    owners = json_literal(dictionary.owners(), "map<string,string>")
    return F.try_element_at(owners, F.lower(name))


def canonicalize(mentions: DataFrame, raw: str, aliases: DataFrame) -> DataFrame:
    """Add ``canonical`` (and ``category``) to rows of raw names by an equi-join.

    ``aliases`` has form, canonical, category, ord and may be of any size: the first owner of
    each form is picked with an aggregate, and the planner chooses the join from the sizes.
    """
    owner = aliases.groupBy(F.lower("form").alias("_form")).agg(
        F.min_by(F.struct("canonical", "category"), "ord").alias("_owner")
    )
    return (
        mentions.withColumn("_form", F.lower(raw))
        .join(owner, "_form", "left")
        .withColumns({"canonical": F.col("_owner.canonical"), "category": F.col("_owner.category")})
        .drop("_form", "_owner")
    )


def canonical_label(canonical: Column, raw: Column) -> Column:
    return F.coalesce(canonical, F.lower(raw))


# --- keyword classes -----------------------------------------------------------
def _has_keyword(lowered: Column, words: Sequence[str], match: str) -> Column:
    if match == "substring":
        return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])
    either = "|".join(_java_phrase(w.strip()) for w in words)
    return F.rlike(lowered, F.lit(rf"(?<![a-z0-9])(?:{either})(?![a-z0-9])"))


def first_class(lowered: Column, classes, match: str = "substring") -> Column:
    """Label of the first class with a keyword in the text, else NULL."""
    return F.coalesce(
        *[F.when(_has_keyword(lowered, words, match), F.lit(label)) for label, words in classes]
    )


def all_classes(lowered: Column, classes, limit: int, match: str = "substring") -> Column:
    """Labels of the first ``limit`` classes with a keyword in the text."""
    labels = [F.when(_has_keyword(lowered, words, match), F.lit(label)) for label, words in classes]
    return F.slice(F.array_compact(F.array(*labels)), 1, limit)


def detect_seniority(
    text: Column, levels=tuple(fixed.SENIORITY_LEVELS), match: str = "substring"
) -> Column:
    return first_class(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), levels, match)


def detect_family(
    text: Column, families=tuple(fixed.TITLE_FAMILIES), match: str = "substring"
) -> Column:
    return first_class(F.lower(text), families, match)


def detect_domain(text: Column, domains=tuple(fixed.DOMAINS), match: str = "substring") -> Column:
    return first_class(F.lower(text), domains, match)


def detect_domains(
    text: Column, domains=tuple(fixed.DOMAINS), limit: int = 3, match: str = "substring"
) -> Column:
    return all_classes(F.lower(text), domains, limit, match)


def normalize_title(
    title: Column,
    dictionary: SkillDictionary | None = None,
    levels=tuple(fixed.SENIORITY_LEVELS),
    families=tuple(fixed.TITLE_FAMILIES),
    match: str = "substring",
) -> Column:
    """``struct<normalized_title, seniority, family>``.

    Without a family keyword the first skill in the title names the family.
    """
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    family = first_class(padded, families, match)
    if dictionary is not None and dictionary.skills:
        skill = F.get(extract_skills(title, dictionary, 3), F.lit(0))["canonical"]
        family = F.coalesce(family, F.concat(skill, F.lit(" specialist")))

    def finish(pair: Column) -> Column:
        level, kind = pair["seniority"], pair["family"]
        said = F.array_contains(find_all(padded, r"\S+"), level)
        return F.struct(
            F.when(
                level.isNotNull() & kind.isNotNull() & ~said, F.concat_ws(" ", level, kind)
            )
            .otherwise(trim_space(title))
            .alias("normalized_title"),
            level.alias("seniority"),
            kind.alias("family"),
        )

    pair = F.struct(first_class(padded, levels, match).alias("seniority"), family.alias("family"))
    return let(pair, finish)


# --- places ----------------------------------------------------------------------
_EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
PLACE_TYPE = "struct<city:string,country:string,region:string>"


@dataclass(frozen=True)
class PlaceDictionary:
    """Aliases of cities and countries, plus region groups tried only when neither occurs."""

    cities: tuple = tuple(fixed.CITY_ALIASES)
    countries: tuple = tuple(fixed.COUNTRY_ALIASES)
    regions: tuple = tuple(fixed.REGION_ALIASES)

    def records(self) -> list[dict]:
        """Cities before countries, longer aliases before shorter: the order ties are broken."""
        cities = sorted(self.cities, key=lambda r: -len(r[0]))
        countries = sorted(self.countries, key=lambda r: -len(r[0]))
        rows = [(a, c, k, r) for a, c, k, r in cities] + [(a, None, k, None) for a, k in countries]
        return [
            {
                "anchor": _anchor(alias),
                "pattern": f"{_EDGE[0]}{re.escape(alias)}{_EDGE[1]}",
                "ord": i,
                "place": {"city": city, "country": country, "region": region},
            }
            for i, (alias, city, country, region) in enumerate(rows)
        ]


def find_location(text: Column, places: PlaceDictionary = PlaceDictionary()) -> Column:
    """The earliest city or country in the text, else the first region group; NULL if none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    records = places.records()
    table = json_literal(
        records, f"array<struct<anchor:string,pattern:string,ord:int,place:{PLACE_TYPE}>>"
    )

    def earliest(low: Column) -> Column:
        candidates = let(
            _present(low, [r["anchor"] for r in records]),
            lambda hit: F.filter(table, lambda r: F.array_contains(hit, r["anchor"])),
        )
        spots = F.transform(
            candidates,
            lambda r: F.struct(
                F.regexp_instr(low, r["pattern"]).alias("at"), r["ord"].alias("ord"),
                r["place"].alias("place"),
            ),
        )
        return F.array_min(F.filter(spots, lambda s: s["at"] > 0))["place"]

    region = F.coalesce(
        *[
            F.when(F.rlike(lowered, F.lit(f"{_EDGE[0]}{re.escape(alias)}{_EDGE[1]}")), F.lit(name))
            for alias, name in places.regions
        ]
    )
    none = F.lit(None).cast("string")
    group = F.struct(none.alias("city"), none.alias("country"), region.alias("region"))
    return F.coalesce(let(lowered, earliest), F.when(region.isNotNull(), group))


__all__ = [
    "MENTION_TYPE", "PLACE_TYPE", "PlaceDictionary", "Skill", "SkillDictionary", "all_classes",
    "canonical_label", "canonical_of", "canonicalize", "default_skills", "detect_domain",
    "detect_domains", "detect_family", "detect_seniority", "expand_skills", "extract_skills",
    "find_location", "first_class", "json_literal", "nonblank", "nonempty", "normalize_title",
    "quote_phrase", "tokenize",
]
