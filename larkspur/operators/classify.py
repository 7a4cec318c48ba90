"""What a listing is: caliber, kind, maker, country and flags, by ordered rules as column expressions.

A rule table is a list of (name, pattern); the first pattern that a text has decides. Evidence is asked in the order of
its strength: what the listing is called before what is said of it, what is stated before what a name implies. Silence
is null. Words are matched as whole words, A-Z in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import collapse_space
from .cartridges import CARTRIDGES, cartridge_table, listed, maker_table, normal
from .phrases import tagged
from .reading import provenance

Rules = list[tuple[str, str]]

# -------------------------------------------------------------------------- rule tables (parameters with defaults)
#: Names that imply a cartridge.
DESIGNATIONS: Rules = [("8mm Mauser", "k98k?|kar ?98k?"), (".30-06", "m1 garand|garand|m1903"), ("7.62x54mmR", "mosin(?:[- ]nagant)?|svt[- ]?40"), ("7.62x39mm", "sks|akm?"), (".45 ACP", "m?1911(?:a1)?"), (".303 British", "lee[- ]enfield|smle")]
#: What a maker's long guns usually shoot; never asked of a handgun.
MAKER_CALIBERS: Rules = [("8mm Mauser", "mauser"), (".30-30 Winchester", "winchester")]
HANDGUN = "pistols?|revolvers?|handguns?|derringers?"
LONG_GUN = "rifles?|carbines?|muskets?|shotguns?"
FORMS: Rules = [("revolver", "revolvers?"), ("derringer", "derringers?"), ("pistol", "pistols?|handguns?"), ("carbine", "carbines?"), ("musket", "muskets?"), ("shotgun", "shotguns?"), ("rifle", "rifles?")]
#: A vendor's own words for a kind.
STATED_KINDS: Rules = [("rifle", "rifles?|long guns?|bolt action"), ("pistol", "pistols?|semi auto pistols?"), ("revolver", "revolvers?|wheel guns?"), ("shotgun", "shotguns?")]
#: Things that belong to a gun, as the head of a title.
ACCESSORIES = "magazines?|mags?|slings?|holsters?|scopes?|mounts?|stocks?|grips?|clips?|stripper clips?|cleaning kits?|cases?|bolts?|barrels?|sights?|bipods?|pouch(?:es)?|scabbards?|manuals?|tools?"
COUNTRIES: Rules = [("Austria", "austrian?"), ("Czechoslovakia", "czech(?:oslovakian?)?|vz ?\\d{2}"), ("Finland", "finnish|finland"), ("Germany", "german|germany|wwii k98k?"), ("Japan", "japan(?:ese)?|arisaka"), ("Russia", "russian?|soviet|mosin"), ("Sweden", "swedish|sweden"), ("Switzerland", "swiss|switzerland"), ("United Kingdom", "british|england|enfield"), ("United States", r"u\.?s\.?|american|usgi")]
PARTS_KIT = "parts? kits?|build kits?|demill?ed|de-mill?ed"
OTHER_KIT = "cleaning kits?|service kits?|repair kits?|tool kits?"
KIT = "kits?"
BAYONET, SCABBARD, COMES_WITH = "bayonets?", "scabbards?", r"with|w/|includes?|and"
POLICE = "police trade[- ]?ins?|le trade[- ]?ins?|department trade[- ]?ins?|police surplus"
REPRODUCTION = "reproductions?|replicas?|re-?creations?|non[- ]firing|denix|modern copy"
BLACK_POWDER = "black ?powder|muzzle ?load(?:er|ing)|percussion|flintlock|cap (?:and|&) ball"
CARTRIDGE_GUN = "cartridge conversion|rimfire|centerfire"
SUPPRESSOR, NFA_SECTION, SUPPRESSOR_PART = "suppressors?|silencers?", "nfa", "mounts?|caps?|covers?|pistons?|adapters?|wipes?"
SMALL, LARGE = "compact|sub-?compact|micro|pocket|snub(?: ?nose)?|officers?", "full[- ]size|government|target|long slide"
NEW_WORDS, USED_WORDS = "new|nib|new in box|factory new", "used|pre-?owned|surplus|trade[- ]?in"
#: Rows that the catalog does not carry, with the reason.
UNWANTED: Rules = [("airsoft", "airsoft|bb guns?"), ("toy", "toys?|cap guns?"), ("ammunition only", "ammo can|ammunition only")]


def low(text: Column) -> Column:
    return collapse_space(F.lower(F.coalesce(text, F.lit(""))))


def says(text: Column, words: str) -> Column:
    """Whether a lower-case text has one of the words as a whole."""
    return text.rlike(rf"(?<![a-z0-9.])(?:{words})(?![a-z0-9])")


def first_rule(text: Column, rules: Rules) -> Column:
    """The name of the first rule of a table that a lower-case text has."""
    return F.coalesce(*[F.when(says(text, pattern), F.lit(name)) for name, pattern in rules])


def earliest_rule(text: Column, rules: Rules) -> Column:
    """The name of the rule that a text has first, reading from the left; of equal places the earlier rule."""
    before = lambda p: F.length(F.regexp_extract(text, rf"^(.*?)(?<![a-z0-9.])(?:{p})(?![a-z0-9])", 1))
    found = F.array_compact(F.array(*[F.when(says(text, p), F.struct(before(p).alias("at"), F.lit(i).alias("rule"), F.lit(name).alias("name"))) for i, (name, p) in enumerate(rules)]))
    return F.array_min(found)["name"]


def group(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


#: A measure: a word for caliber before it, the number, and its unit.
_MEASURE = r"(?<![\w./-])(?:(cal|caliber|calibre)\.? ?)?(\.?\d{1,3}(?:\.\d{1,2})?)(?: ?-?(mm|cal|caliber|calibre|ga|gauge|bore))?(?![\w/-]|\.\d)"
#: Units by what they measure. A bore is a gauge from 4 to 32; a diameter in millimetres is from 4 to 20.
CALIBER_WORDS, GAUGE_WORDS = ["cal", "caliber", "calibre"], ["ga", "gauge"]


def measures(text: Column) -> Column:
    """All measures of a lower-case text in order: ``array<struct<before, number, unit>>``, empty strings where a part is not there."""
    parts = [F.regexp_extract_all(text, F.lit(_MEASURE), i) for i in (1, 2, 3)]
    return F.arrays_zip(*[c.alias(n) for c, n in zip(parts, ("before", "number", "unit"))])


def worded_bore(text: Column) -> Column:
    """A bore in words: ``.69 caliber``, ``10 gauge``, ``18 bore`` (the same measure as gauge)."""

    def read(m: Column) -> Column:
        digits, whole = F.regexp_replace(m["number"], r"^\.", ""), m["number"].cast("double")
        caliber = (m["unit"].isin(CALIBER_WORDS) | ((m["before"] != "") & (m["unit"] == ""))) & digits.rlike(r"^\d{2,3}$")
        gauge = ~m["number"].contains(".") & (m["unit"].isin(GAUGE_WORDS) & whole.between(1, 99) | (m["unit"] == "bore") & whole.between(4, 32))
        return F.when(caliber, F.concat(F.lit("."), digits)).when(gauge, F.concat(m["number"], F.lit(" Gauge")))

    found = F.filter(F.transform(measures(text), read), lambda x: x.isNotNull())
    # a caliber before a gauge, as a shotgun's listing may name a rifled barrel
    return F.coalesce(F.get(F.filter(found, lambda x: x.startswith(".")), F.lit(0)), F.get(found, F.lit(0)))


def metric_caliber(text: Column) -> Column:
    """``6.5x55`` and the like, that no table names; not a telescope's ``3-9x40``."""
    pattern = r"(?<![\w.\-])(\d{1,2}(?:\.\d{1,2})?) ?[x×] ?(\d{2})(?: ?mm)?( ?r)?\b"
    wide, length, rim = group(text, pattern), group(text, pattern, 2), F.regexp_extract(text, pattern, 3)
    return F.when(wide.cast("double").between(4.0, 15.0) & wide.isNotNull(), F.concat(wide, F.lit("x"), length, F.lit("mm"), F.upper(F.trim(rim))))


def bare_bore(text: Column) -> Column:
    """A bore by itself: ``.45`` or ``11mm``."""
    found = measures(text)
    pointed = F.filter(found, lambda m: m["number"].rlike(r"^\.\d{2,3}$"))
    metric = F.filter(found, lambda m: (m["unit"] == "mm") & m["number"].cast("double").between(4.0, 20.0))
    return F.coalesce(F.get(pointed, F.lit(0))["number"], F.concat(F.get(metric, F.lit(0))["number"], F.lit("mm")))


def is_accessory(title: Column, price: Column, floor: float = 60.0) -> Column:
    """Whether a title names a thing for a gun: its head noun is one, or it is too cheap to be the gun that it names.

    The head is what stands before ``for``, ``with``, a comma or a dash.
    """
    text = F.regexp_replace(low(title), r"(?<![\w.])(\.?\d{2,3}) ?(?:[a-z&]+ )?mag(?![a-z])", "$1 magnum")  # a cartridge, not a magazine
    head = F.trim(F.regexp_extract(text, r"^(.*?)(?: for | with | w/|,| - |$)", 1))
    named = head.rlike(rf"(?<![a-z])(?:{ACCESSORIES})$")
    cheap = F.coalesce(price < floor, F.lit(False)) & says(text, ACCESSORIES)
    return named | cheap


def calibered(rows: DataFrame, cartridges: DataFrame | None = None, makers: DataFrame | None = None) -> DataFrame:
    """``rows`` (title, description, price) with ``caliber`` and ``maker``.

    The caliber is what the title states, then the description: the longest spelling of the cartridge table decides. Then
    what a name implies, a metric or worded or bare bore, and what the maker's long guns shoot. The maker is the one that
    the title names first, else the description. Both tables (``phrase, value``) are matched by an automaton each.
    """
    spark = rows.sparkSession
    cartridges = cartridge_table(spark) if cartridges is None else cartridges
    makers = maker_table(spark) if makers is None else makers
    title, text = normal(F.col("title")), normal(F.col("description"))
    out = rows
    for into, where, names, first in (("_ct", title, cartridges, False), ("_cd", text, cartridges, False), ("_mt", title, makers, True), ("_md", text, makers, True)):
        out = tagged(out, where, names, into, first=first)
    t, both = low(F.col("title")), low(F.concat_ws(" ", "title", "description"))
    either = lambda rule: F.coalesce(rule(t), rule(both))
    found = F.coalesce("_ct", "_cd", first_rule(both, DESIGNATIONS), metric_caliber(both), either(worded_bore), bare_bore(both), F.when(~says(t, HANDGUN), first_rule(both, MAKER_CALIBERS)))
    price = F.col("price") if "price" in rows.columns else F.lit(None).cast("double")
    return out.withColumns({"caliber": F.when(~is_accessory(F.col("title"), price), found), "maker": F.coalesce("_mt", "_md")}).drop("_ct", "_cd", "_mt", "_md")


def finer_kind(model_kind: Column, stated: Column, title: Column, section: Column) -> Column:
    """The model's kind, the vendor's word for it, the form that the title names, the section's: the first that says anything."""
    word = F.regexp_replace(low(stated), "-", " ")
    return F.coalesce(model_kind, first_rule(word, STATED_KINDS), first_rule(low(title), FORMS), first_rule(low(section), FORMS))


def is_parts_kit(title: Column, section: Column, description: Column) -> Column:
    """A gun without its numbered part: the title says so, or the section does and the listing has a kit that is no other kit."""
    t = low(title)
    rest = F.regexp_replace(t, OTHER_KIT, " ")
    own = F.regexp_replace(low(F.concat_ws(" ", title, description)), OTHER_KIT, " ")
    only_other = says(t, KIT) & ~says(rest, KIT)
    return says(rest, PARTS_KIT) | (~only_other & says(low(section), PARTS_KIT) & says(own, KIT))


def is_bayonet(title: Column, description: Column) -> Column:
    """A bayonet, and not a gun that comes with one; a scabbard counts where the listing speaks of a bayonet."""
    t = low(title)
    alone = says(t, BAYONET) & ~t.rlike(rf"(?<![a-z])(?:{COMES_WITH}) .*?(?<![a-z])(?:{BAYONET})(?![a-z])") & ~t.rlike(rf"(?:without|no|missing) (?:its )?(?:{BAYONET})")
    sheath = ~says(t, BAYONET) & says(t, SCABBARD) & says(low(description), BAYONET)
    return alone | sheath


def gun_kind(title: Column, section: Column, description: Column, price: Column) -> Column:
    """``rifle``, ``pistol`` or null, by vetoes in order: a parts kit, a bayonet or an accessory is no gun; a title's form before a section's."""
    none = is_parts_kit(title, section, description) | is_bayonet(title, description) | is_accessory(title, price)
    side = lambda text: F.when(says(text, HANDGUN), "pistol").when(says(text, LONG_GUN), "rifle")
    return F.when(~none, F.coalesce(side(low(title)), side(low(section))))


def says_land(spelling: str) -> bool:
    """Whether a cartridge's spelling has the name of a land in it."""
    return any(re.search(rf"(?<![a-z0-9.])(?:{p})(?![a-z0-9])", spelling) for _, p in COUNTRIES)


def country(title: Column, description: Column) -> Column:
    """The land that a title names first, else the description; words that are part of a cartridge's name don't count."""
    cartridges = "|".join(sorted((re.escape(p) for p, name in listed(CARTRIDGES) if says_land(p)), key=len, reverse=True)) + "|7\\.62 russian"
    masked = lambda c: F.regexp_replace(low(c), rf"(?<![a-z0-9.])(?:{cartridges})(?![a-z0-9])", " ")
    return F.coalesce(earliest_rule(masked(title), COUNTRIES), earliest_rule(masked(description), COUNTRIES))


def modern_country(read: Column, model: Column, modern: Column, maker: Column) -> Column:
    """The model's own land, for modern production the maker's; only without either what was read from the words."""
    return F.coalesce(model, F.when(F.coalesce(modern, F.lit(False)), maker), read)


def newness(stated: Column, sells: Column, title: Column, section: Column) -> Column:
    """New, used or unknown: the vendor's word, what the shop sells, and of a shop that sells both the section's and the title's words."""
    words = lambda text: F.when(says(low(text), USED_WORDS), False).when(says(low(text), NEW_WORDS), True)
    by_shop = F.when(sells == "new", True).when(sells == "used", False).when(sells == "mixed", F.coalesce(words(section), words(title)))
    return F.coalesce(stated, by_shop)


def is_carry(title: Column, kind: Column, bore: Column, barrel: Column, most: float = 4.1) -> Column:
    """A handgun made to be carried: a known bore, and a small one by name or barrel; a full-size name decides against it."""
    t = low(title)
    small = says(t, SMALL) | F.coalesce(barrel <= most, F.lit(False))
    return F.coalesce(kind.isin("pistol", "revolver", "derringer") & bore.isNotNull() & ~says(t, LARGE) & small, F.lit(False))


def is_black_powder(title: Column, section: Column, gun: Column, parts_kit: Column) -> Column:
    """A gun that its title or section calls one of black powder, unless the title says that it shoots cartridges."""
    t = low(title)
    return F.coalesce(gun.isNotNull() & ~parts_kit & ~says(t, CARTRIDGE_GUN) & (says(t, BLACK_POWDER) | says(low(section), BLACK_POWDER)), F.lit(False))


def is_suppressor(title: Column, section: Column, parts_kit: Column, bayonet: Column) -> Column:
    """A suppressor: not a gun or a part by its title; the registered section's word settles it, else its name or the section's."""
    t, s = low(title), low(section)
    alone = F.regexp_replace(t, rf"(?:with|w/) (?:[a-z]+ ){{0,2}}?(?:{SUPPRESSOR})", " ")
    named = ~says(t, SUPPRESSOR_PART) & (says(alone, SUPPRESSOR) | says(s, SUPPRESSOR))
    return ~parts_kit & ~bayonet & ~says(t, f"{HANDGUN}|{LONG_GUN.replace('rifles?|', '')}") & (says(s, NFA_SECTION) | named)


def is_police(title: Column, section: Column, gun: Column) -> Column:
    """A department's trade-in: the section or title says so, and it is a gun."""
    return gun.isNotNull() & (says(low(section), POLICE) | says(low(title), POLICE))


def is_reproduction(title: Column) -> Column:
    return says(low(title), REPRODUCTION)


def unwanted(title: Column, maker: Column, rules: Rules = UNWANTED) -> Column:
    """Why a row is not carried; null for one that is."""
    return first_rule(low(F.concat_ws(" ", title, maker)), rules)


def carried(rows: DataFrame, title: str = "title", maker: str = "maker") -> DataFrame:
    """``rows`` without the unwanted ones."""
    return rows.where(unwanted(F.col(title), F.col(maker)).isNull())


def can_key(title: Column, makers: Rules) -> Column:
    """A key that two shops' rows of one suppressor share: the maker, and the first two words left when those that describe are gone."""
    text = F.regexp_extract(low(title), r"^(.*?)(?: [-–|] | / |$)", 1)
    maker = first_rule(text, makers)
    bare = F.regexp_replace(text, "|".join(p for _, p in makers), " ")
    bare = F.regexp_replace(bare, r"\d+(?:\.\d+)? ?(?:in|mm|cal)\b|(?<![\w])\.\d{2,3}|\"", " ")
    bare = F.regexp_replace(bare, rf"(?<![a-z])(?:{SUPPRESSOR}|rifle|pistol|black|fde|titanium|direct|thread|mount)(?![a-z])", " ")
    words = F.array_join(F.slice(F.regexp_extract_all(bare, F.lit("([a-z0-9]+)"), 1), 1, 2), "")
    return F.when(maker.isNotNull() & (words != ""), F.concat(maker, F.lit(":"), words))


def enrich(rows: DataFrame) -> DataFrame:
    """``rows`` (title, description, section, price) with everything read at once: ``caliber, maker, gun, kind, country`` and the flags."""
    title, description, section, price = map(F.col, ("title", "description", "section", "price"))
    none = F.lit(None).cast("string")
    out = calibered(rows).withColumns({"is_parts_kit": is_parts_kit(title, section, description), "is_bayonet": is_bayonet(title, description), "is_reproduction": is_reproduction(title), "gun": gun_kind(title, section, description, price), "country": country(title, description)})
    out = out.withColumn("kind", F.when(F.col("gun").isNotNull(), finer_kind(none, none, title, section)))
    return out.withColumns({"is_police": is_police(title, section, F.col("gun")), "is_black_powder": is_black_powder(title, section, F.col("gun"), F.col("is_parts_kit")), "is_suppressor": is_suppressor(title, section, F.col("is_parts_kit"), F.col("is_bayonet"))})


def reclassify(rows: DataFrame, fields: tuple[str, ...] = ("caliber", "country", "kind")) -> DataFrame:
    """The stored rows read anew: each field with its source, and which fields changed.

    A stored field is ``f`` with ``f_source``. A vendor's word stays; what was derived before is replaced by what is read
    now; where nothing is read, the old value stays.
    """
    kept = [c for c in rows.columns if c not in fields]
    read = enrich(rows.select(*kept, *[F.col(f).alias(f"old_{f}") for f in fields]))
    made = {f: provenance(F.col(f"old_{f}"), F.col(f"{f}_source"), F.col(f), "derived", "claim") for f in fields}
    out = read.select(*[c for c in kept if not c.endswith("_source")], *[F.col(f"old_{f}") for f in fields], *[v.alias(f"new_{f}") for f, v in made.items()])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"new_{f}.value").eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]))
    return out.select(*[c for c in kept if not c.endswith("_source")], *[x for f in fields for x in (F.col(f"new_{f}.value").alias(f), F.col(f"new_{f}.source").alias(f"{f}_source"))], changed.alias("changed"))


def designations(rows: DataFrame, key: str, title: str, known: list[str], least: int = 2) -> DataFrame:
    """Names of models that titles suggest: a maker's word and a number after it, seen in enough rows, and not known yet.

    Parentheses, lots, cartridges and measures are taken out first; a bare number is no name.
    """
    text = F.regexp_replace(low(F.col(title)), r"\([^)]*\)|lot of \d+|#\d+|\d+(?:\.\d+)? ?(?:mm|in|inch|cal)\b|\.\d{2,3}", " ")
    found = F.regexp_extract_all(collapse_space(text), F.lit(r"(?<![a-z0-9])([a-z]{2,}[ -]?\d{1,4}[a-z]?)(?![a-z0-9])"), 1)
    names = rows.select(key, F.explode(F.array_distinct(found)).alias("name"))
    counts = names.where(~F.col("name").isin(known)).groupBy("name").agg(F.count_distinct(key).alias("sightings"))
    return counts.where(F.col("sightings") >= least)


def year_names(rows: DataFrame, key: str, title: str, makers: list[str], least: int = 2) -> DataFrame:
    """Names of a maker and a year ("mauser 1893"), unless the year is a date (made, dated or built before it, or a month)."""
    makers_re = "|".join(makers)
    text = low(F.col(title))
    dated = text.rlike(r"(?:dated|made|built|circa|in|from) (?:in )?1[89]\d\d")
    found = F.when(~dated, group(text, rf"(?<![a-z])((?:{makers_re}) (?:model |m)?1[89]\d\d)(?!\d|[-/]\d)"))
    named = rows.select(key, F.regexp_replace(found, " (?:model |m)(?=1)", " ").alias("name")).where("name is not null")
    return named.groupBy("name").agg(F.count_distinct(key).alias("sightings")).where(F.col("sightings") >= least)


def attributed(rows: DataFrame, key: str, model: str, title: str, description: str, firms: DataFrame) -> DataFrame:
    """``key, firm``: the factory that a row names, among those that made its model (``firms``: model, firm, mark, name).

    A title's before a description's, a mark before a name, the earliest, the longest. A description that names several
    firms is a list and attributes nothing.
    """
    places = []
    for where, text in ((1, title), (0, description)):
        for by_mark, spelling in ((1, "mark"), (0, "name")):
            at = F.instr(F.concat(F.lit(" "), F.regexp_replace(low(F.col(text)), "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.lower(F.col(spelling)), F.lit(" ")))
            places.append(F.when(at > 0, F.struct(F.lit(where).alias("title"), F.lit(by_mark).alias("mark"), (-at).alias("early"), F.length(spelling).alias("long"))))
    met = rows.join(firms, model).select(key, "firm", F.explode(F.array_compact(F.array(*places))).alias("p"))
    in_text = met.where("p.title = 0").groupBy(key).agg(F.count_distinct("firm").alias("firms"))
    hits = met.join(in_text, key, "left").where((F.col("p.title") == 1) | (F.col("firms") == 1))
    return hits.groupBy(key).agg(F.max_by("firm", F.struct("p", "firm")).alias("firm"))
