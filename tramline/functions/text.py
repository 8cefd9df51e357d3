"""Parsers and normalisers of outside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag, category, priority, in the order in which they are tried.
POI_TAGS = (
    ("amenity=hospital", "Hospital", 1),
    ("amenity=bus_station", "Terminal de Ônibus", 1),
    ("amenity=ferry_terminal", "Terminal de Barcas", 1),
    ("railway=station", "Estação de Trem/Metrô", 1),
    ("railway=subway_entrance", "Entrada do Metrô", 1),
    ("leisure=shopping_centre", "Shopping", 1),
    ("shop=mall", "Shopping", 1),
    ("shop=department_store", "Loja de Departamentos", 1),
    ("building=retail", "Shopping", 1),
    ("leisure=stadium", "Estádio", 1),
    ("amenity=university", "Universidade", 1),
    ("amenity=college", "Faculdade", 2),
    ("amenity=clinic", "Clínica", 2),
    ("shop=supermarket", "Supermercado", 2),
    ("amenity=marketplace", "Mercado/Feira", 2),
    ("amenity=pharmacy", "Farmácia", 2),
    ("amenity=bank", "Banco", 2),
    ("amenity=post_office", "Correios", 2),
    ("amenity=police", "Delegacia/Polícia", 2),
    ("amenity=fire_station", "Bombeiros", 2),
    ("amenity=theatre", "Teatro", 2),
    ("amenity=cinema", "Cinema", 2),
    ("tourism=museum", "Museu", 2),
    ("amenity=library", "Biblioteca", 2),
    ("amenity=fuel", "Posto de Gasolina", 2),
    ("shop=convenience", "Conveniência/Mercearia", 2),
    ("amenity=school", "Escola", 3),
    ("leisure=park", "Parque", 3),
    ("tourism=attraction", "Atração Turística", 3),
    ("historic=landmark", "Marco Histórico", 3),
)
#: Words that make a name a shopping centre's, and categories that need a longer name.
MALL_WORDS = ("shopping", "mall", "plaza", "centre", "center", "galeria", "comercial")
UNSURE = ("Parque", "Atração Turística", "Marco Histórico", "Conveniência/Mercearia", "Posto de Gasolina")

ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def decimal_comma(x: Column) -> Column:
    """A double written with comma or point; null if it is none."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def number_or_zero(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))


def epoch_millis(x: Column, as_of: Column) -> Column:
    """Text of milliseconds since 1970 as a timestamp; ``as_of`` where it is no number."""
    return F.coalesce(F.timestamp_millis(F.trim(x).try_cast("bigint")), as_of)


def double_key(x: Column) -> Column:
    """A double as text of 17 digits: equal texts for equal numbers only."""
    return F.format_string("%.16e", x)


def upper_trim(x: Column) -> Column:
    return F.upper(F.trim(x))


def plain_name(x: Column) -> Column:
    """Lower case without accents; slashes and dashes are spaces, runs of spaces one."""
    t = F.translate(F.lower(F.trim(x)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[/-]", " "), " +", " "))


def _has_mall_word(name: Column) -> Column:
    low, out = F.lower(name), F.lit(False)
    for w in MALL_WORDS:
        out = out | low.contains(w)
    return out


def poi_name(tags: Column) -> Column:
    """The first of name:pt, name, brand that is present, blank or not."""
    return F.when(F.map_contains_key(tags, "name:pt"), tags["name:pt"]).when(F.map_contains_key(tags, "name"), tags["name"]).otherwise(tags["brand"])


def poi_class(tags: Column, name: Column) -> Column:
    """(category, priority), null where neither a tag nor the name tells."""
    out = None
    for tag, category, priority in POI_TAGS:
        key, value = tag.split("=")
        made = F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"))
        test = tags[key] == value
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.when(_has_mall_word(name), F.struct(F.lit("Shopping").alias("category"), F.lit(1).alias("priority")))


def poi_trusted(category: Column, name: Column) -> Column:
    """Whether an unsure category's name supports it."""
    return F.when(category == "Shopping", _has_mall_word(name)).when(category.isin(*UNSURE), F.length(F.trim(name)) >= 5).otherwise(True)


def log_entry(line: Column, as_of: Column) -> Column:
    """(ts, level, message) of a log line: a time stamp, a space, the rest."""
    at = F.instr(line, " ")
    stamp = F.when(at > 0, F.substring(line, F.lit(1), at - 1))
    rest = F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(line)
    low = F.lower(rest)
    level = F.when(low.contains("error") | low.contains("fail"), "error").when(low.contains("warn"), "warn").otherwise("info")
    return F.struct(F.coalesce(F.try_to_timestamp(stamp), as_of).alias("ts"), level.alias("level"), rest.alias("message"))
