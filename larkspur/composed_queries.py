"""The readers of text over listings that are composed of the tables' columns: what is read is a function of the row, which the SQL computes without reading."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import cartridges
from .operators import classify as K
from .operators import reading as R
from .queries import query
from .sources import feeds
from .sources.tables import dealt, table

SENT = datetime(2024, 12, 20, 12)
_GRADES = "['like new', 'excellent', 'very good', 'good', 'fair', 'poor']"


def composed(name: str, made: dict[str, str], sql: str, read: Callable[[DataFrame], dict[str, Column]], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, source: str = "part", key: str = "p_partkey") -> None:
    """Registers a query ``name``: columns composed of a table's row (expressions ``made``), what is read of them, and the SQL for the answers."""

    def run(spark, folder):
        rows = table(spark, folder, source)
        rows = (dealt(rows) if source == "part" else rows).select("*", *[F.expr(e).alias(f"_{c}") for c, e in made.items()])
        rows = prepare(rows.select(key, *[F.col(f"_{c}").alias(c) for c in made]))
        return rows.select(key, *[c.alias(a) for a, c in read(rows).items()])

    run.__name__ = run.__qualname__ = name
    query(f"SELECT {key}, {sql} FROM {source}")(run)


# ------------------------------------------------------------------------------------------------------------- traits
composed(
    "read_import_marks",
    {"t": """CASE p_partkey % 5 WHEN 0 THEN concat('A fine thing. Small import mark under the ', p_name, '. Ships free') WHEN 1 THEN concat('Clean. No import marks on the ', p_name) WHEN 2 THEN concat('There may be an import mark on the ', p_name)
      WHEN 3 THEN concat('No pitting and an IMPORT-STAMP  on the ', p_name, '; good') ELSE p_name END"""},
    "p_partkey % 5 IN (0, 3) OR CASE WHEN p_partkey % 5 IN (2, 4) THEN NULL ELSE false END AS value, CASE p_partkey % 5 WHEN 0 THEN 'small import mark under the ' || p_name WHEN 1 THEN 'no import marks on the ' || p_name WHEN 3 THEN 'no pitting and an import-stamp on the ' || p_name END AS quote",
    lambda r: {"value": R.TRAITS["import_marked"].read(r.t)["value"], "quote": R.TRAITS["import_marked"].read(r.t)["quote"]},
)
composed(
    "read_matching_numbers",
    {"t": """concat(p_name, '. ', CASE p_size % 3 WHEN 0 THEN 'All matching' WHEN 1 THEN 'All visible numbers appear matching' ELSE 'Serial numbers are matching' END,
      CASE p_partkey % 6 WHEN 0 THEN '.' WHEN 1 THEN concat(' except the ', p_name, '.') WHEN 2 THEN '. Non-matching bayonet included.' WHEN 3 THEN concat('. The ', p_name, ' does not match.') WHEN 4 THEN concat(', but the finish of the ', p_name, ' is worn.') ELSE '. Mis-matched bolt.' END)"""},
    "p_partkey % 6 IN (0, 2, 4) AS value",
    lambda r: {"value": R.TRAITS["numbers_match"].read(r.t)["value"]},
)
composed(
    "read_finish",
    {"t": """CASE p_partkey % 5 WHEN 0 THEN concat('The ', p_name, ' has been re-blued. Bright') WHEN 1 THEN concat(p_name, ' never refinished') WHEN 2 THEN concat('Retains ', 40 + p_size, '-', 41 + p_size, '% of its original finish')
      WHEN 3 THEN concat('The refinished stock of the ', p_name) ELSE concat('Original finish remaining about ', 40 + p_size, '%') END"""},
    "CASE p_partkey % 5 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS refinished, CASE WHEN p_partkey % 5 IN (2, 4) THEN 40 + p_size END::INTEGER AS left_percent",
    lambda r: {"refinished": R.TRAITS["refinished"].read(r.t)["value"], "left_percent": R.finish_percent(r.t)},
)
_WORDS = "array('like new', 'excellent', 'very good', 'good', 'fair', 'poor')"
composed(
    "read_grades",
    {"word": f"CASE p_partkey % 3 WHEN 0 THEN concat(initcap(element_at({_WORDS}, p_size % 6 + 1)), '+') WHEN 1 THEN concat(upper(element_at({_WORDS}, p_size % 6 + 1)), ' to ', element_at({_WORDS}, int(p_partkey % 6 + 1))) ELSE p_name END",
     "t": f"CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE concat(p_name, '. Overall condition is ', element_at({_WORDS}, int(p_partkey % 5 + 2)), '. The bore is ', element_at({_WORDS}, p_size % 5 + 2), ', the rest is new') END"},
    f"CASE p_partkey % 3 WHEN 0 THEN {_GRADES}[p_size % 6 + 1] WHEN 1 THEN {_GRADES}[greatest(p_size % 6, p_partkey % 6) + 1] END AS of_word, CASE WHEN p_partkey % 4 <> 3 THEN {_GRADES}[p_partkey % 5 + 2] END AS overall, CASE WHEN p_partkey % 4 <> 3 THEN {_GRADES}[p_size % 5 + 2] END AS bore",
    lambda r: {"of_word": R.grade(r.word), "overall": R.overall_grade(r.t), "bore": R.bore_grade(r.t)},
)
composed(
    "trait_groups",
    {"import_marked": "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END", "numbers_match": "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END"},
    "p_partkey % 3 = 1 AND p_size % 3 <> 2 AS no_mark_and_told, p_partkey % 3 <> 2 AS either",
    lambda r: {"no_mark_and_told": R.trait_filter({"import_marked": [False], "numbers_match": [True, False]}), "either": R.trait_filter({"import_marked": [True, False]})},
)

# -------------------------------------------------------------------------------------------------- years and measures
composed(
    "read_years",
    {"t": """CASE p_partkey % 4 WHEN 0 THEN concat('Manufactured in ', 1880 + p_size, ' by ', p_brand) WHEN 1 THEN concat('made from ', 1880 + p_size, ' to ', 1881 + p_size + p_partkey % 9) WHEN 2 THEN concat('circa ', floor(p_size / 10) * 10 + 1880, 's ', p_name) ELSE concat('Replica of the ', 1880 + p_size) END"""},
    """CASE WHEN p_partkey % 4 < 2 THEN 1880 + p_size WHEN p_partkey % 4 = 2 THEN p_size // 10 * 10 + 1880 END::INTEGER AS first, CASE p_partkey % 4 WHEN 0 THEN 1880 + p_size WHEN 1 THEN 1881 + p_size + p_partkey % 9 WHEN 2 THEN p_size // 10 * 10 + 1889 END::INTEGER AS last,
      CASE p_partkey % 4 WHEN 1 THEN (1880 + p_size) || ',' || (1881 + p_size + p_partkey % 9) WHEN 2 THEN '' ELSE (1880 + p_size)::VARCHAR END AS stated, CASE WHEN p_partkey % 4 < 2 THEN 1880 + p_size END::INTEGER AS earliest""",
    lambda r: {"first": R.made(r.t)["first"], "last": R.made(r.t)["last"], "stated": F.array_join(F.transform(C.years(r.t), lambda y: y.cast("string")), ","), "earliest": R.curio(r.t)["year"]},
)
composed(
    "curio_verdicts",
    {"t": "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ', C&R eligible') WHEN 1 THEN concat('Not C&R eligible: ', p_name) ELSE p_name END", "own": "CASE WHEN p_partkey % 5 > 0 THEN 1950 + p_size END", "until": "CASE WHEN p_partkey % 3 > 0 THEN 1930 + p_size END", "source": "element_at(array('stated', 'serial', 'table'), p_size % 3 + 1)"},
    """CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS stated, CASE p_partkey % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'not_eligible' ELSE
      CASE WHEN coalesce(CASE WHEN p_size % 3 <> 1 AND p_partkey % 3 > 0 THEN 1930 + p_size END, CASE WHEN p_partkey % 5 > 0 THEN 1950 + p_size END, CASE WHEN p_size % 3 = 1 AND p_partkey % 3 > 0 THEN 1930 + p_size END) <= 1974 THEN 'eligible'
           WHEN coalesce(CASE WHEN p_size % 3 <> 1 AND p_partkey % 3 > 0 THEN 1930 + p_size END, CASE WHEN p_partkey % 5 > 0 THEN 1950 + p_size END, CASE WHEN p_size % 3 = 1 AND p_partkey % 3 > 0 THEN 1930 + p_size END) > 1974 THEN 'not_eligible' ELSE 'unknown' END END AS verdict""",
    lambda r: {"stated": R.curio(r.t)["stated"], "verdict": R.verdict(R.curio(r.t)["stated"], R.judged_year(r.own, r.until, r.source), 2024)},
)
composed(
    "read_measures",
    {"title": """concat(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN concat(2 + p_size % 25, ' 1/2" barrel') WHEN 1 THEN 'Sub-Compact' ELSE concat(1 + p_size % 30, '+1 compact') END)""",
     "description": """concat('Good. ', CASE p_partkey % 3 WHEN 1 THEN concat('Barrel length: ', 2 + p_size % 25, '.25 in. Capacity: ', 1 + p_size % 30, '.') ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN ' Threaded barrel.' WHEN 1 THEN ' No threaded barrel.' ELSE '' END)"""},
    """CASE p_partkey % 3 WHEN 0 THEN 2.5 + p_size % 25 WHEN 1 THEN 2.25 + p_size % 25 END::DOUBLE AS barrel, CASE WHEN p_partkey % 3 > 0 THEN 1 + p_size % 30 END::INTEGER AS rounds, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS threaded, CASE p_partkey % 3 WHEN 1 THEN 'subcompact' WHEN 2 THEN 'compact' END AS frame""",
    lambda r: {"barrel": R.barrel_inches(r.title, r.description), "rounds": R.capacity(r.title, r.description), "threaded": R.threaded(r.description), "frame": R.frame_size(r.title)},
)
composed(
    "read_serials",
    {"t": "CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '. Serial number AB-', 1000 + p_partkey, 'XX') WHEN 1 THEN concat('Serial no. ', 5000 + p_partkey * 3) WHEN 2 THEN concat('serial # K', 10 + p_size, '***') ELSE concat(p_name, ' ', p_partkey) END"},
    "CASE p_partkey % 4 WHEN 0 THEN 'AB' WHEN 1 THEN '' WHEN 2 THEN 'K' END AS prefix, CASE p_partkey % 4 WHEN 0 THEN (1000 + p_partkey) * 100 WHEN 1 THEN 5000 + p_partkey * 3 WHEN 2 THEN (10 + p_size) * 1000 END::BIGINT AS low, CASE p_partkey % 4 WHEN 0 THEN (1000 + p_partkey) * 100 + 99 WHEN 1 THEN 5000 + p_partkey * 3 WHEN 2 THEN (10 + p_size) * 1000 + 999 END::BIGINT AS high",
    lambda r: {k: R.serial(r.t)[k] for k in ("prefix", "low", "high")},
)
composed(
    "read_numbers",
    {"t": "CASE p_partkey % 3 WHEN 0 THEN concat('$', format_number(p_retailprice, 2), ' for ', p_name) WHEN 1 THEN concat(p_size, ' 3/4 ', p_name, ' for sale') ELSE concat(p_size, '½') END", "was": "CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END", "now": "p_retailprice / 2"},
    """CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_size > 0 THEN p_size END::DOUBLE AS amount, CASE p_partkey % 3 WHEN 1 THEN p_size + 0.75 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS mixed,
      CASE p_partkey % 3 WHEN 0 THEN rtrim(left(format('${:,.2f} for', p_retailprice), 8)) || '…' WHEN 1 THEN p_size || ' 3/4…' ELSE p_size || '½' END AS short, CASE WHEN p_partkey % 7 > 0 THEN 50.0 END::DOUBLE AS dropped""",
    lambda r: {"amount": C.money(r.t), "mixed": C.mixed_number(r.t), "short": C.truncate_words(r.t, 8), "dropped": C.percent_drop(r.was, r.now)},
)
composed(
    "ordered_tokens",
    {"t": "concat('The ', upper(p_name), ', the ', p_name, ' and ', p_partkey + 100, '!')"},
    "replace(p_name, ' ', ',') || ',' || (p_partkey + 100) AS words",
    lambda r: {"words": F.array_join(C.tokens(r.t, ["the", "and"]), ",")},
)

# ------------------------------------------------------------------------------------------------- letters and notices
composed(
    "read_offers",
    {"t": """CASE c_custkey % 5 WHEN 0 THEN concat('Take ', 1 + c_custkey % 90, '% off! Use code AUTUMN', c_custkey, ' today, just for you') WHEN 1 THEN concat('Free shipping, valid for ', 1 + c_custkey % 90, ' hours') WHEN 2 THEN concat('$', 1 + c_custkey % 90, ' off, good for ', 1 + c_custkey % 20, ' days')
      WHEN 3 THEN concat('10% off ends 12/', 21 + c_custkey % 9) ELSE concat('News of ', c_name, '. Code of conduct') END"""},
    """CASE c_custkey % 5 WHEN 0 THEN (1 + c_custkey % 90) || '% off' WHEN 1 THEN 'free shipping' WHEN 2 THEN '$' || (1 + c_custkey % 90) || ' off' WHEN 3 THEN '10% off' END AS discount, CASE WHEN c_custkey % 5 = 0 THEN 'AUTUMN' || c_custkey END AS code, CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 5 = 0 END AS personal,
      CASE c_custkey % 5 WHEN 1 THEN TIMESTAMP '2024-12-20 12:00:00' + to_hours(1 + c_custkey % 90) WHEN 2 THEN TIMESTAMP '2024-12-20 12:00:00' + to_days((1 + c_custkey % 20)::INTEGER) WHEN 3 THEN TIMESTAMP '2024-12-22 04:59:00' + to_days((c_custkey % 9)::INTEGER) END AS ends""",
    lambda r: {**{k: R.offer(r.t)[k] for k in ("discount", "code", "personal")}, "ends": R.offer_end(r.t, F.lit(SENT).cast("timestamp")).cast("timestamp_ntz")},
    source="customer", key="c_custkey",
)
_KEPT = "concat('A fine old ', p_name, ' by ', p_brand, ' with a bright bore and good wood. It shoots well, number ', p_partkey, '.')"
composed(
    "read_without_notices",
    {"t": f"CASE p_partkey % 4 WHEN 0 THEN concat({_KEPT}, ' No returns. All sales are final.') WHEN 1 THEN concat('Nice ', p_name, '. All sales final.') WHEN 2 THEN concat('No returns on ', p_name, '. ', {_KEPT}) ELSE concat({_KEPT}, ' Please read: no returns.') END"},
    f"CASE p_partkey % 4 WHEN 1 THEN 'Nice ' || p_name || '. All sales final.' WHEN 2 THEN 'No returns on ' || p_name || '. ' || {_KEPT} ELSE {_KEPT} END AS kept",
    lambda r: {"kept": R.without_notices(r.t)},
)

# ---------------------------------------------------------------------------------------------------- kinds and fields
_ORDER = R.Kinds().order
composed(
    "kind_buckets",
    {**{f"is_{k}": f"CASE WHEN p_partkey % 11 <> {i} THEN shiftright(p_partkey, {i}) % 2 = 1 END" for i, k in enumerate(_ORDER)}, "extra": "p_size % 2 = 1"},
    "CASE " + " ".join(f"WHEN p_partkey % 11 <> {i} AND (p_partkey >> {i}) % 2 = 1 THEN '{k}'" for i, k in enumerate(_ORDER)) + " END AS single, CASE " + " ".join(f"WHEN p_partkey % 11 <> {i} AND (p_partkey >> {i}) % 2 = 1 THEN '{k}'" + (" || CASE WHEN p_size % 2 = 1 THEN ',pistol' ELSE '' END" if k == "carry" else "") for i, k in enumerate(_ORDER)) + " ELSE '' END AS several",
    lambda r: {"single": R.Kinds().single(), "several": F.array_join(R.Kinds().several(r.extra), ",")},
)
composed(
    "fill_with_provenance",
    {"v": "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END", "s": "CASE p_size % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'derived' END", "f": "CASE WHEN p_partkey % 5 > 0 THEN p_brand END"},
    ", ".join(
        f"CASE WHEN p_partkey % 5 > 0 AND ({take}) THEN p_brand ELSE CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END END AS {name}, CASE WHEN p_partkey % 5 > 0 AND ({take}) THEN {told} ELSE CASE p_size % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'derived' END END AS {name}_from"
        for name, take, told in (("filled", "p_partkey % 3 > 0", "'derived'"), ("claimed", "p_partkey % 3 > 0 OR p_size % 3 = 1", "'derived'"), ("respelled", "true", "CASE p_size % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'derived' END"))
    ),
    lambda r: {f"{name}{end}": R.provenance(r.v, r.s, r.f, "derived", mode)[part] for name, mode in (("filled", "fill"), ("claimed", "claim"), ("respelled", "respell")) for end, part in (("", "value"), ("_from", "source"))},
)

# -------------------------------------------------------------------------------------------------------- classifier
_NAMES = [line.partition(":")[0] for line in cartridges.CARTRIDGES.strip().splitlines()]
_SPARK_NAMES = "array(" + ", ".join("'" + n + "'" for n in _NAMES) + ")"
_SQL_NAMES = "[" + ", ".join("'" + n + "'" for n in _NAMES) + "]"
composed(
    "extract_calibers",
    {"title": f"concat(p_brand, ' rifle ', CASE WHEN p_partkey % 3 > 0 THEN replace(upper(element_at({_SPARK_NAMES}, int(p_partkey % {len(_NAMES)} + 1))), ' WINCHESTER', ' Win.') ELSE '' END, ', ', p_name)",
     "description": f"CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE concat('Also seen in ', element_at({_SPARK_NAMES}, int(p_size % {len(_NAMES)} + 1)), ' here') END"},
    f"CASE WHEN p_partkey % 3 > 0 THEN {_SQL_NAMES}[p_partkey % {len(_NAMES)} + 1] WHEN p_partkey % 4 > 0 THEN {_SQL_NAMES}[p_size % {len(_NAMES)} + 1] END AS caliber",
    lambda r: {"caliber": F.col("caliber")},
    K.calibered,
)
_MAKERS = [line.partition(":")[0] for line in cartridges.MAKERS.strip().splitlines()]
composed(
    "read_makers",
    {"title": f"CASE WHEN p_partkey % 3 > 0 THEN concat('A ', element_at(array({', '.join(chr(39) + m + chr(39) for m in _MAKERS)}), int(p_partkey % {len(_MAKERS)} + 1)), ' after a Walther, ', p_name) ELSE p_name END", "description": f"CASE WHEN p_partkey % 2 = 0 THEN concat('by ', upper(element_at(array({', '.join(chr(39) + m + chr(39) for m in _MAKERS)}), int(p_size % {len(_MAKERS)} + 1)))) END"},
    f"CASE WHEN p_partkey % 3 > 0 THEN [{', '.join(chr(39) + m + chr(39) for m in _MAKERS)}][p_partkey % {len(_MAKERS)} + 1] WHEN p_partkey % 2 = 0 THEN [{', '.join(chr(39) + m + chr(39) for m in _MAKERS)}][p_size % {len(_MAKERS)} + 1] END AS maker",
    lambda r: {"maker": F.col("maker")},
    K.calibered,
)
composed(
    "bore_words",
    {"t": "CASE p_partkey % 6 WHEN 0 THEN concat('.', 20 + p_size, ' caliber ', p_name) WHEN 1 THEN concat(4 + p_size % 29, ' bore ', p_name) WHEN 2 THEN concat(4 + p_size % 9, '.', 1 + p_size % 8, 'x', 20 + p_size, 'r ', p_name) WHEN 3 THEN concat(4 + p_size % 17, 'mm ', p_name) WHEN 4 THEN concat('cal. ', 20 + p_size, ' ', p_name) ELSE concat(p_size % 10, '/10 bore, 3-9x40 ', p_name) END"},
    """CASE p_partkey % 6 WHEN 0 THEN '.' || (20 + p_size) WHEN 1 THEN (4 + p_size % 29) || ' Gauge' WHEN 4 THEN '.' || (20 + p_size) END AS worded, CASE WHEN p_partkey % 6 = 2 THEN (4 + p_size % 9) || '.' || (1 + p_size % 8) || 'x' || (20 + p_size) || 'mmR' END AS metric,
      CASE p_partkey % 6 WHEN 0 THEN '.' || (20 + p_size) WHEN 3 THEN (4 + p_size % 17) || 'mm' END AS bare""",
    lambda r: {"worded": K.worded_bore(r.t), "metric": K.metric_caliber(r.t), "bare": K.bare_bore(r.t)},
)
composed(
    "gun_decisions",
    {"title": "concat(p_brand, ' ', element_at(array('rifle', 'revolver', 'bayonet', 'rifle magazine', 'parts kit', 'sling for rifle', 'thing', 'carbine with bayonet'), int(p_partkey % 8 + 1)))", "description": "p_name", "section": "CASE p_size % 3 WHEN 0 THEN 'Rifles' WHEN 1 THEN 'Pistols' END", "price": "p_retailprice"},
    """CASE p_partkey % 8 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' WHEN 6 THEN CASE p_size % 3 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' END WHEN 7 THEN 'rifle' END AS gun, CASE p_partkey % 8 WHEN 0 THEN 'rifle' WHEN 1 THEN 'revolver' WHEN 6 THEN CASE p_size % 3 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' END WHEN 7 THEN 'carbine' END AS kind,
      p_partkey % 8 = 4 AS parts_kit, p_partkey % 8 = 2 AS bayonet, p_partkey % 8 IN (3, 5) AS accessory""",
    lambda r: {"gun": K.gun_kind(r.title, r.section, r.description, r.price), "kind": F.when(K.gun_kind(r.title, r.section, r.description, r.price).isNotNull(), K.finer_kind(F.lit(None).cast("string"), F.lit(None).cast("string"), r.title, r.section)), "parts_kit": K.is_parts_kit(r.title, r.section, r.description), "bayonet": K.is_bayonet(r.title, r.description), "accessory": K.is_accessory(r.title, r.price)},
)
composed(
    "finer_kinds",
    {"model": "CASE WHEN p_partkey % 4 = 0 THEN p_type END", "stated": "CASE p_size % 3 WHEN 0 THEN 'Bolt-Action' WHEN 1 THEN p_name END", "title": "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' carbine' WHEN 1 THEN ' musket' ELSE '' END)", "section": "CASE WHEN p_size % 2 = 0 THEN 'Revolvers' END"},
    "CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_size % 3 = 0 THEN 'rifle' WHEN p_partkey % 3 = 0 THEN 'carbine' WHEN p_partkey % 3 = 1 THEN 'musket' WHEN p_size % 2 = 0 THEN 'revolver' END AS kind",
    lambda r: {"kind": K.finer_kind(r.model, r.stated, r.title, r.section)},
)
_LANDS, _PEOPLE = ["Austria", "Finland", "Germany", "Russia", "Sweden", "Switzerland"], ["Austrian", "Finnish", "German", "Soviet", "Swedish", "Swiss"]
composed(
    "countries_and_corrections",
    {"title": f"CASE WHEN p_partkey % 3 > 0 THEN concat('.303 British or ', element_at(array({', '.join(map(repr, _PEOPLE))}), int(p_partkey % 6 + 1)), ' ', p_name) ELSE p_name END", "description": f"concat('a ', element_at(array({', '.join(map(repr, _PEOPLE))}), p_size % 6 + 1), ' piece, sold by a Swiss')", "model": "CASE WHEN p_size % 5 = 0 THEN p_brand END", "modern": "p_partkey % 2 = 0", "maker": "CASE WHEN p_size % 2 = 0 THEN p_type END"},
    f"CASE WHEN p_partkey % 3 > 0 THEN {_LANDS}[p_partkey % 6 + 1] ELSE {_LANDS}[p_size % 6 + 1] END AS named, CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 THEN p_type WHEN p_partkey % 3 > 0 THEN {_LANDS}[p_partkey % 6 + 1] ELSE {_LANDS}[p_size % 6 + 1] END AS settled",
    lambda r: {"named": K.country(r.title, r.description), "settled": K.modern_country(K.country(r.title, r.description), r.model, r.modern, r.maker)},
)
composed(
    "new_or_used",
    {"stated": "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END", "sells": "element_at(array('new', 'used', 'mixed'), p_size % 3 + 1)", "title": "concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' NIB' WHEN 1 THEN ' trade-in' ELSE '' END)", "section": "CASE WHEN p_size % 5 = 0 THEN 'Used guns' END"},
    "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN p_size % 5 = 0 THEN false WHEN p_name LIKE '%new%' THEN CASE WHEN p_partkey % 3 = 1 THEN false ELSE true END WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false END END END AS is_new",
    lambda r: {"is_new": K.newness(r.stated, r.sells, r.title, r.section)},
)
composed(
    "can_keys",
    {"t": "concat(CASE p_partkey % 3 WHEN 0 THEN 'SILENCERCO ' WHEN 1 THEN 'Rugged Suppressors ' ELSE '' END, 'Omega ', p_size, 'M 7.6in Silencer', CASE WHEN p_size % 2 = 0 THEN concat(' - ', p_name) ELSE ' / Black' END)"},
    "CASE p_partkey % 3 WHEN 0 THEN 'silencerco:omega' || p_size || 'm' WHEN 1 THEN 'rugged:omega' || p_size || 'm' END AS can",
    lambda r: {"can": K.can_key(r.t, [("silencerco", "silencerco"), ("rugged", "rugged(?: suppressors)?")])},
)
composed(
    "enrich_listings",
    {"title": f"concat(element_at(array({', '.join(map(repr, _PEOPLE))}), int(p_partkey % 6 + 1)), ' ', CASE p_size % 3 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' ELSE 'parts kit' END, ' 9 mm Luger')", "description": "p_name", "section": "CASE WHEN p_size % 2 = 0 THEN 'LE trade-ins' END", "price": "p_retailprice"},
    f"'9mm Luger' AS caliber, CASE p_size % 3 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' END AS gun, CASE p_size % 3 WHEN 0 THEN 'rifle' WHEN 1 THEN 'pistol' END AS kind, {_LANDS}[p_partkey % 6 + 1] AS country, 'Luger' AS maker, p_size % 3 = 2 AS parts_kit, p_size % 3 <> 2 AND p_size % 2 = 0 AS police, false AS can",
    lambda r: {k: F.col(v) for k, v in {"caliber": "caliber", "gun": "gun", "kind": "kind", "country": "country", "maker": "maker", "parts_kit": "is_parts_kit", "police": "is_police", "can": "is_suppressor"}.items()},
    K.enrich,
)

# --------------------------------------------------------------------------------------------------- markup and searches
composed(
    "html_to_text",
    {"html": "CASE p_partkey % 4 WHEN 0 THEN concat('<p>A <b>', p_name, '</b>&nbsp;&amp; &#36;', p_size, '</p><script>no(\"<p>x</p>\")</script>') WHEN 1 THEN concat('&lt;p&gt;', p_name, ' &amp;amp; more&lt;/p&gt;') WHEN 2 THEN concat('#', p_brand, ' [x]{a:', p_size, ';}') ELSE concat(p_name, '\\n\\n', p_brand) END"},
    "CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_name || ' & $' || p_size WHEN 1 THEN p_name || ' & more' WHEN 2 THEN '#' || p_brand || ' [x]{a:' || p_size || ';}' ELSE p_name || ' ' || p_brand END AS words, p_partkey % 4 <> 2 AS prose",
    lambda r: {"words": feeds.html_text(r.html), "prose": feeds.is_prose(feeds.html_text(r.html))},
)
composed(
    "infobox_fields",
    {"t": "concat('text {{Infobox firearm\\n| name = ', p_name, '\\n| bullet = ', p_size, '.5 mm\\n| length = {{convert|', p_size, '|mm}} about ', p_partkey, '\\n| origin = [[', p_brand, '|', p_type, ']]\\n', CASE WHEN p_partkey % 2 = 0 THEN '| bullet = second' ELSE '' END, '}} more | bullet = no')"},
    "p_size || '.5 mm' AS bullet, 'about ' || p_partkey AS length, p_type AS land",
    lambda r: {"bullet": feeds.infobox(r.t)["bullet"], "length": feeds.infobox(r.t)["length"], "land": feeds.infobox(r.t)["origin"]},
)
