"""Text rules as column expressions: conditions, labels, species, whitelists, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grammars of quantities and units.
NUMBER = r"((?:\d\.)?\d{1,3})"
COREACTANT = NUMBER + r"\s?(equivalents?|equiv\.?|eq\.?|m?L)"
CATALYST = NUMBER + r"\s?(mol\s?%|M|wt\s?%|%\s\w+)"
TEMPERATURE = r"(?i)(-?\d{1,4}\s?(?=\s?[o0°]C|K)|r\.?\s?t\.?|heat|reflux|room\s?temp)(\s?[o0°]C|K)?"
TIME = r"(?<!\w)" + NUMBER + r"\s?(h(?:ours?)?|m(?:in)?|s(?:econds)?|days?)(?=$|\s?,)"
PRESSURE = r"(\d{1,4}\s?(?=[mhkM]?Pa|m?bar|atm)|U?HV|vacuum)([mhkM]?Pa|m?bar|atm)?"
YIELD = r"(\d{1,2}\s?(?=%)|gram scale)(%)?"
SPECIES = (
    r"((?:[A-Z]*\d?[a-z]\d?)\((?:[A-Z]*\d?[a-z]?\d?)*\)?\d?[A-Z]*[a-z]*\d?)",
    r"(?<!°)\b(?<!\)|\()((?:[A-Z]+\d?[a-z]?\d?)+)(?!\(|\))\b",
    r"((?<!°)\b[A-Z]{1,4}\b)(?!\)|\.)",
    r"(\b[a-z]\b)(?!\)|\.)",
    r"(?:^| )(?<!\w)([1-9])(?!\w)(?!\))(?:$|[, ])(?![A-Za-z])",
)
#: In the order of routing: the first rule that matches consumes the entity.
ROUTES = {"coreactants": COREACTANT, "catalysts": CATALYST, "temperature": TEMPERATURE, "time": TIME, "pressure": PRESSURE, "yield": YIELD}
QUANTITIES = ("temperature", "time", "pressure", "yield")


def entities(line: Column) -> Column:
    """The parts of a conditions line: cut at commas (decimal commas aside), each separator
    taking the character behind it."""
    marked = F.regexp_replace(line, r",(?!\d)", "#")
    return F.transform(F.split(marked, "#.", -1), lambda e: F.trim(F.regexp_replace(e, "^#+|#+$", "")))


def is_species(entity: Column, dictionary: list[str] | None = None) -> Column:
    """The intended recognition of chemical names: a slash, a listed name or a formula."""
    found = F.contains(entity, F.lit("/"))
    for name in dictionary or []:
        found = found | F.contains(entity, F.lit(name))
    for rule in SPECIES:
        found = found | entity.rlike(rule)
    return found


def route(entity: Column) -> Column:
    """Which field takes an entity. What no rule takes is a species: recognition there accepts
    everything, empty strings too."""
    out = F
    for name, rule in ROUTES.items():
        out = out.when(entity.rlike(rule), name)
    return out.otherwise("other_species")


def quantity(entity: Column, kind: str) -> Column:
    """struct(value_num, value_text, units) of the first match: a number where the value is
    one, else its text; units 'N/A' where there are none."""
    value, units = F.regexp_extract(entity, ROUTES[kind], 1), F.regexp_extract(entity, ROUTES[kind], 2)
    number = value.try_cast("double")
    return F.struct(number.alias("value_num"), F.when(number.isNull(), value).alias("value_text"), F.coalesce(F.nullif(units, F.lit("")), F.lit("N/A")).alias("units"))


def parsed_conditions(lines: Column) -> Column:
    """The record of an array of condition lines: three lists of names, and four lists of
    quantities (null when empty). One expression, with no shuffle: lines of a region are few."""
    parts = F.flatten(F.transform(lines, entities))
    routed = F.transform(parts, lambda e: F.struct(route(e).alias("k"), e.alias("e")))
    of = lambda k: F.transform(F.filter(routed, lambda x: x["k"] == k), lambda x: x["e"])
    names = [of(k).alias(k) for k in ("catalysts", "coreactants", "other_species")]
    found = lambda k: F.transform(of(k), lambda e: quantity(e, k))
    return F.struct(*names, *(F.when(F.size(of(k)) > 0, found(k)).alias(k) for k in ("temperature", "pressure", "time", "yield")))


def label_type(text: Column) -> Column:
    variants = ((F.length(text) < 8) & text.rlike(r"\d+-\d+$")) | text.rlike(r"\d+[A-Za-z]-[A-Za-z]$")
    return F.when(text.isNull(), "UNKNOWN").when(variants, "VARIANTS").otherwise("SIMPLE")


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def label_root(text: Column) -> Column:
    """The number of a simple label or before letters; null for a range of numbers."""
    spread = r"(\d+)[A-Za-z]-[A-Za-z]$"
    kind = label_type(text)
    return F.when(kind == "SIMPLE", text).when(text.rlike(spread), F.regexp_extract(text, spread, 1))


def label_variants(text: Column) -> Column:
    """The numbers of a range n-m, or the letters of nx-y; null for simple labels."""
    num, let = r"(\d+)-(\d+)$", r"\d+([A-Za-z])-([A-Za-z])$"
    a, b = (F.regexp_extract(text, num, i).cast("int") for i in (1, 2))
    i, j = (F.position(F.regexp_extract(text, let, k), F.lit(_LETTERS)) for k in (1, 2))
    numbers = F.when(a <= b, F.transform(F.sequence(a, b), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    letters = F.when(i <= j, F.transform(F.sequence(i, j), lambda k: F.substr(F.lit(_LETTERS), k, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.when((label_type(text) == "VARIANTS") & text.rlike(let), letters).when(label_type(text) == "VARIANTS", numbers)


def leading_digits(text: Column) -> Column:
    """Null where the text starts with none: labels are similar when these are equal."""
    return F.nullif(F.regexp_extract(text, r"^\d+", 0), F.lit(""))


def is_plus_sign(text: Column) -> Column:
    """A plus sign read as a text region; null texts aren't."""
    return F.coalesce(text.rlike(r"\+") & (F.length(text) < 4), F.lit(False))


def whitelisted(text: Column, allowed: str) -> Column:
    """The text without characters that aren't in the allowed set (a regex class body)."""
    return F.regexp_replace(text, f"[^{allowed}]", "")


def decoded_tokens(tokens: Column, vocabulary: dict[int, str]) -> Column:
    """Tokens by index, joined, without the start and end marks."""
    table = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    return F.replace(F.replace(F.array_join(F.transform(tokens, lambda i: F.coalesce(F.element_at(table, i), F.lit(""))), ""), F.lit("<start>"), F.lit("")), F.lit("<end>"), F.lit(""))


def step_text(reactants: Column, products: Column) -> Column:
    """'A + B  -->  C', with ??? for missing or empty names."""
    side = lambda a: F.array_join(F.transform(a, lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("???"))), " + ")
    return F.concat(side(reactants), F.lit("  -->  "), side(products))
