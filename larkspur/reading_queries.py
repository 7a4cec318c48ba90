"""Lists of listings with their right answers, for the readers of text and the classifier. Most queries of these names are over composed listings (``composed_queries``); the lists are read by the tests."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import classify as K
from .operators import reading as R
from .queries import query
from .sources.tables import dealt, table


def case_rows(part: DataFrame, names: str, inputs: list[tuple]) -> DataFrame:
    """``p_partkey`` and the columns ``names`` (name and type pairs) of the case whose number is the key modulo their number."""
    kinds = [x.split() for x in names.split(",")]
    case = F.pmod("p_partkey", F.lit(len(inputs))).cast("int") + 1
    made = [F.element_at(F.array(*[F.lit(row[i]).cast(kind) for row in inputs]), case).alias(name) for i, (name, kind) in enumerate(kinds)]
    return dealt(part.select("p_partkey")).select("p_partkey", *made)


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, datetime):
        return f"TIMESTAMP '{x}'"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


#: By name: the types of the inputs, the listed rows, what is read, what prepares it, and the names of the answers. The tests read them all.
CASES: dict[str, tuple] = {}


def cases(name: str, takes: str, gives: str, listed: list[tuple], read: Callable[[DataFrame], dict[str, Column]], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Registers a query ``name``: the columns that ``read`` makes of the cases; the SQL has the listed answers (after the inputs)."""
    n = len(takes.split(","))
    answers = [x.rsplit(" ", 1) if " " in x.strip() else (x, "VARCHAR") for x in gives.split(", ")]
    CASES[name] = (takes, listed, read, prepare, [a for a, _ in answers])
    values = ", ".join("(" + ", ".join([str(k), *[literal(x) for x in row[n:]]]) + ")" for k, row in enumerate(listed))
    sql = f"WITH c(k, {', '.join(a for a, _ in answers)}) AS (VALUES {values}) SELECT p_partkey, {', '.join(f'CAST({a} AS {t}) AS {a}' for a, t in answers)} FROM part JOIN c ON p_partkey % {len(listed)} = k"

    def run(spark, folder):
        rows = prepare(case_rows(table(spark, folder, "part"), takes, [row[:n] for row in listed]))
        return rows.select("p_partkey", *[c.alias(a) for a, c in read(rows).items()])

    run.__name__ = run.__qualname__ = name
    query(sql)(run)


# ------------------------------------------------------------------------------------------------ traits and grades
cases("read_import_marks", "t string", "value BOOLEAN, quote", [
    ("Small import mark under the barrel. A fine rifle.", True, "small import mark under the barrel"), ("No visible import marks.", False, "no visible import marks"),
    ("No import marks on the receiver; small import stamp on the barrel.", True, "small import stamp on the barrel"), ("There may be an import mark.", None, None),
    ("Collectors look for those without import marks", None, None), ("No pitting and an import mark on the barrel", True, "no pitting and an import mark on the barrel"),
    ("A fine rifle", None, None), (None, None, None), ("Importer marked on the slide", True, "importer marked on the slide"),
], lambda r: {"value": R.TRAITS["import_marked"].read(r.t)["value"], "quote": R.TRAITS["import_marked"].read(r.t)["quote"]})

cases("read_matching_numbers", "t string", "value BOOLEAN", [
    ("All matching numbers.", True), ("Matching numbers except the bolt.", False), ("All matching. Mismatched magazine.", False), ("The bolt does not match.", False), ("Numbers are not matching", False),
    ("All matching numbers in excellent condition except for the bore", True), ("All visible serial numbers match", True), ("Electro-penciled bolt", False), ("Force matched in the arsenal", False), ("A nice one", None), (None, None),
    ("All matching numbers. Non-matching bayonet included.", True), ("Comes in a non-matching plastic box with a non-matching test target", None), ("All numbers appear matching", True), ("The numbered parts are matching", True), ("Matching numbers other than the magazine", False), ("Original box (mismatched serial number)", None), ("Non-matching bolt", False), ("It is all matching, with a holster", True),
], lambda r: {"value": R.TRAITS["numbers_match"].read(r.t)["value"]})

cases("read_finish", "t string", "refinished BOOLEAN, left_percent INTEGER", [
    ("It has been refinished.", True, None), ("Never refinished.", False, None), ("Appears to be an old refinish.", None, None), ("Original blued finish.", False, None), ("The refinished stock is nice.", None, None),
    ("Arsenal rebuilt, re-blued", True, None), ("Retains 93-94% of its original finish", False, 93), ("Original finish remaining about 85%", False, 85), ("Retains 3% finish", None, None), (None, None, None),
], lambda r: {"refinished": R.TRAITS["refinished"].read(r.t)["value"], "left_percent": R.finish_percent(r.t)})

cases("read_grades", "word string, t string", "of_word, overall, bore", [
    ("Excellent+", "Overall condition is very good. Bore is dark.", "excellent", "very good", "dark"), ("very  good plus", "The rifle is in fair to good condition", "very good", "fair", None), ("Poor to Fair", "in good working order", "poor", None, None),
    ("near-mint", "Overall excellent. The bore is fair", "like new", None, "fair"), ("NEW", "Condition: good", "like new", "good", None), ("odd", None, None, None, None), ("good to odd", "A bright bore", "good", None, "bright"), (None, "", None, None, None),
], lambda r: {"of_word": R.grade(r.word), "overall": R.overall_grade(r.t), "bore": R.bore_grade(r.t)})

# ------------------------------------------------------------------------------------------------ years and curios
cases("read_years", "t string", "first INTEGER, last INTEGER, stated, earliest INTEGER", [
    ("Manufactured in 1917 by x", 1917, 1917, "1917", 1917), ("made from 1941 to 1944", 1941, 1944, "1941,1944", 1941), ("circa 1920s", 1920, 1929, "", None), ("C&R eligible, dated 1990", 1990, 1990, "1990", None),
    ("receiver dated 1943, rebuilt and dated 1955", 1943, 1943, "1943,1955", 1943), ("Replica of an 1858", None, None, "1858", None), ("Model 1911 pistol", None, None, "1911", None), (None, None, None, None, None),
], lambda r: {"first": R.made(r.t)["first"], "last": R.made(r.t)["last"], "stated": F.array_join(F.transform(C.years(r.t), lambda y: y.cast("string")), ","), "earliest": R.curio(r.t)["year"]})

cases("curio_verdicts", "t string, own int, until int, source string", "stated BOOLEAN, verdict", [
    ("C&R eligible", None, None, None, True, "eligible"), ("Not C&R eligible, made 1900", None, None, None, False, "not_eligible"), ("dated 1943", 1943, None, None, None, "eligible"), ("a rifle", 1950, 1990, "stated", None, "not_eligible"),
    ("a rifle", 1950, 1990, "serial", None, "eligible"), ("a rifle", None, 1960, "serial", None, "eligible"), ("a rifle", None, None, None, None, "unknown"), ("curio or relic", 2001, None, None, True, "eligible"), (None, 1974, None, None, None, "eligible"), (None, 1975, None, None, None, "not_eligible"),
], lambda r: {"stated": R.curio(r.t)["stated"], "verdict": R.verdict(R.curio(r.t)["stated"], R.judged_year(r.own, r.until, r.source), 2024)})

# --------------------------------------------------------------------------------------------- numbers and measures
cases("read_measures", "title string, description string", "barrel DOUBLE, rounds INTEGER, threaded BOOLEAN, frame", [
    ('Rifle 16.5" barrel', None, 16.5, None, None, None), ("x", "Barrel length: 4 1/2 in. Capacity: 8. Threaded barrel", 4.5, 8, True, None), ("6 inch round barrel", "barrel 9 inches", 6.0, None, None, None), ("no length", "The barrel is not threaded.", None, None, None, None),
    ('99" barrel', None, None, None, None, None), ("with 20rnd magazine, compact", "No threaded barrel", None, 20, False, "compact"), ("15+1 Sub-Compact", "barrel 102 mm", 4.0, 15, None, "subcompact"), ("900 rounds full size", "", None, None, None, "full"), (None, None, None, None, None, None),
], lambda r: {"barrel": R.barrel_inches(r.title, r.description), "rounds": R.capacity(r.title, r.description), "threaded": R.threaded(r.description), "frame": R.frame_size(r.title)})

cases("read_serials", "t string", "prefix, low BIGINT, high BIGINT", [
    ("Serial number AB-1234XX", "AB", 123400, 123499), ("Serial no. 55512", "", 55512, 55512), ("serial # K77***", "K", 77000, 77999), ("no number", None, None, None), (None, None, None, None),
], lambda r: {k: R.serial(r.t)[k] for k in ("prefix", "low", "high")})

cases("read_numbers", "t string, was double, now double", "amount DOUBLE, mixed DOUBLE, short, dropped DOUBLE", [
    ("$1,250.00 today", 200.0, 150.0, 1250.0, None, "$1,250.00…", 25.0), ("4 1/2", 0.0, 1.0, 4.0, 4.5, "4 1/2", None), ("4½ inch", None, 1.0, 4.0, 4.5, "4½ inch", None), ("was 99.5, now $ 89", 80.0, 100.0, 89.0, None, "was 99.5,…", -25.0),
    ("0.00", 100.0, 99.0, None, 0.0, "0.00", 1.0), ("a-very-long-word", 1.0, None, None, None, "a-very-long-…", None), (None, None, None, None, None, None, None),
], lambda r: {"amount": C.money(r.t), "mixed": C.mixed_number(r.t), "short": C.truncate_words(r.t, 12), "dropped": C.percent_drop(r.was, r.now)})

cases("ordered_tokens", "t string", "words", [
    ("The Red ring, the RED Ring 12 and 345", "red,ring,345"), ("b a b c1 a", ""), ("Zeta alpha zeta beta", "zeta,alpha,beta"), ("", ""), (None, ""),
], lambda r: {"words": F.array_join(C.tokens(r.t, ["the", "and"]), ",")})

# ------------------------------------------------------------------------------------------------ letters and notices
SENT = datetime(2024, 12, 20, 12)
cases("read_offers", "t string", "discount, code, personal BOOLEAN, ends TIMESTAMP", [
    ("Take 15% off! Use code AUTUMN15 today, just for you", "15% off", "AUTUMN15", True, None), ("New arrivals. Code of conduct", None, None, None, None), ("Free shipping, valid for 24 hours", "free shipping", None, False, datetime(2024, 12, 21, 12)),
    ("$20 off, good for 3 days", "$20 off", None, False, datetime(2024, 12, 23, 12)), ("10% off ends 12/24", "10% off", None, False, datetime(2024, 12, 25, 4, 59)), ("5% off through 1/5", "5% off", None, False, datetime(2025, 1, 6, 4, 59)), (None, None, None, None, None),
], lambda r: {**{k: R.offer(r.t)[k] for k in ("discount", "code", "personal")}, "ends": R.offer_end(r.t, F.lit(SENT).cast("timestamp")).cast("timestamp_ntz")})

_LONG = "A fine old rifle with a bright bore and good wood, all matching. It shoots well."
cases("read_without_notices", "t string", "kept", [
    (f"{_LONG} No returns. All sales are final.", _LONG), ("Nice. All sales final.", "Nice. All sales final."), ("One sentence", "One sentence"), (f"No returns on ammunition. {_LONG}", f"No returns on ammunition. {_LONG}"), (None, None),
], lambda r: {"kept": R.without_notices(r.t)})

# ------------------------------------------------------------------------------------------------ kinds and sources
_FLAGS = ", ".join(f"is_{k} boolean" for k in R.Kinds().order)
cases("kind_buckets", _FLAGS + ", extra boolean", "single, several", [
    (False, None, True, False, True, False, True, "carry", "carry,pistol"), (False, None, True, False, True, False, False, "carry", "carry"), (True, True, False, False, False, True, True, "suppressor", "suppressor"), (False, False, False, True, True, False, None, "police", "police"),
    (False, False, False, False, True, False, True, "rifle", "rifle"), (False, False, False, False, False, False, True, None, ""), (None, None, None, None, None, None, None, None, ""),
], lambda r: {"single": R.Kinds().single(), "several": F.array_join(R.Kinds().several(r.extra), ",")})

cases("trait_groups", "import_marked boolean, numbers_match boolean", "no_mark_and_told BOOLEAN, either BOOLEAN", [
    (False, True, True, True), (False, None, False, True), (True, False, False, True), (None, None, False, False), (False, False, True, True),
], lambda r: {"no_mark_and_told": R.trait_filter({"import_marked": [False], "numbers_match": [True, False]}), "either": R.trait_filter({"import_marked": [True, False]})})

cases("fill_with_provenance", "v string, s string, f string", "filled, filled_from, claimed, claimed_from, respelled, respelled_from", [
    ("a", "vendor", "b", "a", "vendor", "a", "vendor", "b", "vendor"), ("a", "derived", "b", "a", "derived", "b", "derived", "b", "derived"), (None, None, "b", "b", "derived", "b", "derived", "b", None), ("a", "vendor", None, "a", "vendor", "a", "vendor", "a", "vendor"), ("", "x", "b", "b", "derived", "b", "derived", "b", "x"),
], lambda r: {f"{name}{end}": R.provenance(r.v, r.s, r.f, "derived", mode)[part] for name, mode in (("filled", "fill"), ("claimed", "claim"), ("respelled", "respell")) for end, part in (("", "value"), ("_from", "source"))})

# ------------------------------------------------------------------------------------------------------- classifier
cases("extract_calibers", "title string, description string", "caliber", [
    ("Zastava M83 .357 Magnum Revolver", "also chambers .38 Special", ".357 Magnum"), ("Mauser K98k rifle", "", "8mm Mauser"), ("Walther PP .22 LR", None, ".22 LR"), ("SKS 7.62x39 carbine", None, "7.62x39mm"), ("Swedish rifle 6.5x55", None, "6.5x55mm"),
    ("Brown Bess musket .69 caliber", None, ".69"), ("Parker 10 gauge shotgun", None, "10 Gauge"), ("Holster pistol 22-bore", None, "22 Gauge"), ("Dutch revolver 9.4mm", None, "9.4mm"), ("Mauser sporter", None, "8mm Mauser"), ("Mauser pistol", None, None),
    ("Rifle sling for K98k", None, None), ("Old rifle", "chambered in .303 British", ".303 British"), ("Scope 3-9x40", None, None), (None, None, None), ("Colt 1911 pistol", "", ".45 ACP"),
    ("Uberti .45 Colt revolver", None, ".45 Colt"), ("Ruger 6.5 Creedmoor rifle", None, "6.5 Creedmoor"), ("Savage .243 Win. rifle", None, ".243 Winchester"), ("Marlin 30-30 Win rifle", None, ".30-30 Winchester"), ("VZ 24 in 7.92 x 57 mm", None, "8mm Mauser"), ("Taurus .44 mag", None, ".44 Magnum"),
], lambda r: {"caliber": F.col("caliber")}, K.calibered)

cases("bore_words", "t string", "worded, metric, bare", [
    (".69 caliber musket", ".69", None, ".69"), ("18 bore fowler", "18 Gauge", None, None), ("10 ga double", "10 Gauge", None, None), ("6.5x55 carbine", None, "6.5x55mm", None), ("7x57r single shot", None, "7x57mmR", None), ("11mm revolver", None, None, "11mm"), ("cal. 45 pistol", ".45", None, None), ("9/10 bore condition", None, None, None), ("nothing", None, None, None),
], lambda r: {"worded": K.worded_bore(r.t), "metric": K.metric_caliber(r.t), "bare": K.bare_bore(r.t)})

cases("gun_decisions", "title string, description string, section string, price double", "gun, kind, parts_kit BOOLEAN, bayonet BOOLEAN, accessory BOOLEAN", [
    ("Mosin Nagant rifle", None, "Rifles", 300.0, "rifle", "rifle", False, False, False), ("Colt 1911", None, "Pistols", 900.0, "pistol", "pistol", False, False, False), ("Nagant revolver", None, None, 400.0, "pistol", "revolver", False, False, False), ("M1 carbine with bayonet", None, None, 1200.0, "rifle", "carbine", False, False, False),
    ("K98 bayonet", None, None, 90.0, None, None, False, True, False), ("Leather scabbard", "for the M1 bayonet", None, 40.0, None, None, False, True, True), ("AKM parts kit", None, None, 500.0, None, None, True, False, False), ("Swiss K31 cleaning kit", "a kit", "Parts kits", 30.0, None, None, False, False, True),
    ("FAL front stub kit", None, "Parts kits", 200.0, None, None, True, False, False), ("Rifle magazine", None, "Rifles", 25.0, None, None, False, False, True), ("Sling for Mauser rifle", None, None, 20.0, None, None, False, False, True), ("Old book", None, "Books", 10.0, None, None, False, False, False), (None, None, None, None, None, None, False, False, False),
], lambda r: {"gun": K.gun_kind(r.title, r.section, r.description, r.price), "kind": F.when(K.gun_kind(r.title, r.section, r.description, r.price).isNotNull(), K.finer_kind(F.lit(None).cast("string"), F.lit(None).cast("string"), r.title, r.section)), "parts_kit": K.is_parts_kit(r.title, r.section, r.description), "bayonet": K.is_bayonet(r.title, r.description), "accessory": K.is_accessory(r.title, r.price)})

cases("finer_kinds", "model string, stated string, title string, section string", "kind", [
    ("percussion_revolver", "Revolver", "x", "Pistols", "percussion_revolver"), (None, "Bolt-Action", "German revolver", None, "rifle"), (None, "odd", "Swiss carbine", "Rifles", "carbine"), (None, None, "CHIAPPA 60SAR", "Revolvers", "revolver"), (None, None, "thing", None, None),
], lambda r: {"kind": K.finer_kind(r.model, r.stated, r.title, r.section)})

cases("countries_and_corrections", "title string, description string, model string, modern boolean, maker string", "named, settled", [
    ("Russian capture German K98k", None, None, None, None, "Russia", "Russia"), (".303 British rifle made in Sweden", None, None, None, None, "Sweden", "Sweden"), ("Old rifle", "a Swiss rifle", None, None, None, "Switzerland", "Switzerland"), ("German style pistol", None, None, True, "Turkey", "Germany", "Turkey"),
    ("US import", None, "Belgium", False, "Spain", "United States", "Belgium"), ("Rifle", None, None, False, "Spain", None, None), (None, None, None, None, None, None, None),
], lambda r: {"named": K.country(r.title, r.description), "settled": K.modern_country(K.country(r.title, r.description), r.model, r.modern, r.maker)})

cases("new_or_used", "stated boolean, sells string, title string, section string", "is_new BOOLEAN", [
    (True, "used", "x", None, True), (None, "new", "used rifle", None, True), (None, "used", "new", None, False), (None, "mixed", "NIB pistol", None, True), (None, "mixed", "new pistol", "Used guns", False), (None, "mixed", "rifle", None, None), (None, None, "new", None, None),
], lambda r: {"is_new": K.newness(r.stated, r.sells, r.title, r.section)})

cases("carry_powder_cans", "title string, section string, gun string, kind string, bore string, barrel double", "carry BOOLEAN, powder BOOLEAN, can BOOLEAN, police BOOLEAN, reproduction BOOLEAN", [
    ("Glock 43 subcompact", "Police trade-ins", "pistol", "pistol", "9mm Luger", None, True, False, False, True, False), ("Government 1911 compact", None, "pistol", "pistol", ".45 ACP", 4.0, False, False, False, False, False), ("Target pistol", None, "pistol", "pistol", ".22 LR", 3.0, False, False, False, False, False), ("Small revolver", None, "pistol", "revolver", ".38 Special", 2.0, True, False, False, False, False),
    ("Flintlock musket", None, "rifle", "musket", ".69", None, False, True, False, False, False), ("1858 percussion revolver cartridge conversion", None, "pistol", "revolver", ".45", None, False, False, False, False, False), ("Omega 36M silencer", None, None, None, None, None, False, False, True, False, False), ("Omega mount", "Suppressors", None, None, None, None, False, False, False, False, False),
    ("Obsidian 9", "NFA suppressors", None, None, None, None, False, False, True, False, False), ("Carbine with suppressor", None, "rifle", "carbine", None, None, False, False, False, False, False), ("Replica Colt revolver", "LE trade-in", None, None, None, None, False, False, False, False, True), (None, None, None, None, None, None, False, False, False, False, False),
], lambda r: {"carry": K.is_carry(r.title, r.kind, r.bore, r.barrel), "powder": K.is_black_powder(r.title, r.section, r.gun, F.lit(False)), "can": K.is_suppressor(r.title, r.section, F.lit(False), F.lit(False)), "police": K.is_police(r.title, r.section, r.gun), "reproduction": K.is_reproduction(r.title)})

MAKERS = [("silencerco", "silencerco"), ("rugged", "rugged(?: suppressors)?")]
cases("can_keys", "t string", "can", [
    ("SILENCERCO Omega 36M 7.6in Silencer / Suppressor - Black", "silencerco:omega36m"), ("SilencerCo Omega 36M", "silencerco:omega36m"), ("Rugged Obsidian 9 9mm", "rugged:obsidian9"), ("Rugged Suppressors Obsidian9", "rugged:obsidian9"), ("Nobody's can", None), (None, None),
], lambda r: {"can": K.can_key(r.t, MAKERS)})

_ENRICHED = "caliber, gun, kind, country, parts_kit BOOLEAN, police BOOLEAN, can BOOLEAN"
_STORES = [
    ("Soviet Mosin Nagant rifle", "all matching", "Rifles", 300.0, "7.62x54mmR", "rifle", "rifle", "Russia", False, False, False),
    ("Glock 17 pistol 9mm", "a department gun", "LE trade-ins", 350.0, "9mm Luger", "pistol", "pistol", None, False, True, False),
    ("Swiss K31 service kit", "a kit", "Parts kits", 30.0, None, None, None, "Switzerland", False, False, False),
    ("Hybrid 46 silencer", "", "NFA", 900.0, None, None, None, None, False, False, True),
    (None, None, None, None, None, None, None, None, False, False, False),
]


def _enriched(r: DataFrame) -> dict[str, Column]:
    names = {"caliber": "caliber", "gun": "gun", "kind": "kind", "country": "country", "parts_kit": "is_parts_kit", "police": "is_police", "can": "is_suppressor"}
    return {k: F.col(v) for k, v in names.items()}


_values = ", ".join("(" + ", ".join([str(k), *[literal(x) for x in row[4:]]]) + ")" for k, row in enumerate(_STORES))


@query(f"WITH c(k, caliber, gun, kind, country, parts_kit, police, can) AS (VALUES {_values}) SELECT p_partkey, c.* EXCLUDE (k) FROM part JOIN c ON p_partkey % {len(_STORES)} = k")
def enrich_listings(spark, folder):
    rows = K.enrich(case_rows(table(spark, folder, "part"), "title string, description string, section string, price double", [x[:4] for x in _STORES]))
    return rows.select("p_partkey", *[c.alias(a) for a, c in _enriched(rows).items()])


@query("""WITH c(k, caliber, caliber_source, country, country_source, changed) AS (VALUES (0, '8mm Mauser', 'vendor', 'Russia', 'derived', 'country,kind'), (1, '9mm Luger', 'derived', 'Spain', 'vendor', 'caliber,kind'), (2, '.45 ACP', 'derived', NULL, NULL, ''))
  SELECT p_partkey, c.* EXCLUDE (k) FROM part JOIN c ON p_partkey % 3 = k""")
def reclassify_listings(spark, folder):
    takes = "title string, description string, section string, price double, caliber string, caliber_source string, country string, country_source string, kind string, kind_source string"
    stored = [("Soviet Mosin Nagant rifle", "", "Rifles", 300.0, "8mm Mauser", "vendor", "Sweden", "derived", None, None), ("Glock 17 pistol 9mm", "", "Pistols", 350.0, None, None, "Spain", "vendor", "revolver", "derived"), ("Colt", "", None, 500.0, ".45 ACP", "derived", None, None, None, None)]
    out = K.reclassify(case_rows(table(spark, folder, "part"), takes, stored))
    return out.select("p_partkey", "caliber", "caliber_source", "country", "country_source", F.array_join("changed", ",").alias("changed"))


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN 'airsoft' WHEN p_partkey % 7 = 0 THEN 'toy' END AS reason FROM part""")
def unwanted_reasons(spark, folder):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Airsoft "), "p_name")).when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" toy"))).otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", "p_name", K.unwanted(name, F.lit(None).cast("string")).alias("reason"))


@query("SELECT p_partkey FROM part WHERE p_brand <> 'Brand#3'")
def carried_rows(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_brand") == "Brand#3", "Cap Gun Co").otherwise(F.col("p_brand")).alias("maker"))
    return K.carried(rows).select("p_partkey")


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'vz' || (p_size % 30 + 20) WHEN 1 THEN 'mas-' || (p_size % 30 + 20) END AS name FROM part)
  SELECT name, count(*) AS sightings FROM n WHERE name IS NOT NULL AND name NOT IN ('vz24') GROUP BY 1 HAVING count(*) >= 2""")
def designation_candidates(spark, folder):
    n = (F.col("p_size") % 30 + 20).cast("string")
    title = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Brno VZ"), n, F.lit(" rifle (lot 7) 8mm"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("French MAS-"), n, F.lit(" 22 in barrel"))).otherwise("Rifle 1234")
    rows = table(spark, folder, "part").select("p_partkey", title.alias("title"))
    return K.designations(rows.where(F.col("title") != "Rifle 1234"), "p_partkey", "title", ["vz24"])


@query("""SELECT 'mauser ' || (1890 + p_size % 9) AS name, count(*) AS sightings FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 HAVING count(*) >= 2""")
def year_named_candidates(spark, folder):
    year = (F.col("p_size") % 9 + 1890).cast("string")
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Argentine Mauser M"), year, F.lit(" carbine"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Mauser rifle dated "), year)).otherwise(F.col("p_name"))
    return K.year_names(table(spark, folder, "part").select("p_partkey", title.alias("title")), "p_partkey", "title", ["mauser", "steyr"])


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'tula' WHEN 1 THEN 'izhevsk' WHEN 2 THEN 'tula' END AS firm FROM part WHERE p_partkey % 5 < 3""")
def arsenal_attribution(spark, folder):
    part = table(spark, folder, "part")
    texts = [("Mosin by Tula", "Izhevsk made the others"), ("Mosin", "with the bow mark of the works"), ("Tula star and Izhevsk rifle", None), ("Mosin", "Tula and Izhevsk both made them"), ("A Remington", "nothing")]
    rows = case_rows(part, "title string, description string", texts).withColumn("model", F.lit("mosin"))
    firms = spark.createDataFrame([("mosin", "tula", "star", "Tula"), ("mosin", "izhevsk", "bow mark", "Izhevsk"), ("sks", "remington", "ring", "Remington")], "model string, firm string, mark string, name string")
    return K.attributed(rows, "p_partkey", "model", "title", "description", firms)
