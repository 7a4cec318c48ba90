"""Reading facts out of a listing's words: rules as column expressions, with silence (null) as an answer of its own.

A text is cut into sentences. A rule looks at each sentence for itself: what it claims, whether a denial stands close
before the claim, and whether the sentence is about the model in general or only a guess. The answers of the sentences
are then put together in the rule's order. Everything is built from array and pattern functions of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, collapse_space, mixed_number

# ------------------------------------------------------------------------------------------- fixed values: words
# The answers are defined by these words; each list is whole and in its natural order, and a space is any white space.
#: A sentence with one of these is about the model, and not about this item.
GENERIC = "especially|particularly|examples|collectors?|desirable|sought|premium|rarely|hard to find|look for|if|when|whether|typically|usually"
#: The vendor is not saying.
HEDGES = r"may|might|possibly|perhaps|probably|likely|suggest\w*|think|believe|consistent with|whether|can'?t say|cannot (?:say|confirm)|unsure"
#: Of a finish, this is not saying either.
LOOKS = "appears?|seems?|looks like"
#: A denial, and the words that end its reach; it reaches four words.
DENIALS = "no|not|non|without|never|free of|lacks?|lacking|absent|absence of|can'?t find|cannot find|could ?n[o']t find|did ?n[o']t find|nor"
JOINTS = "and|but|with|is|are|was|were|on|in"
REACH = 4
IMPORT_MARK = r"import(?:er)?(?:'?s)?[ -]*(?:mark|stamp)(?:s|ed|ings?)?"
REFINISH = r"re[ -]*finish(?:ed)?|re[ -]*blu(?:ed|ing|e)|re[ -]*park(?:erized|ed)|re[ -]*nickel(?:ed|led)|refurbished|arsenal (?:refurbish(?:ed|ment)|re[ -]*work(?:ed)?|rebuil[dt]|reconditioned)"
ORIGINAL_FINISH = "original (?:factory )?(?:blued? |parkerized |nickel |military )?finish(?:es)?|factory (?:original )?finish"
WOOD = r"stocks?|grips?|handguards?|wood|forend|fore-?end|butt ?stock|lacquer\w*|varnish\w*|shellac|cartouches?|panels?"
GRADES = ["like new", "excellent", "very good", "good", "fair", "poor"]
GRADE_SPELLINGS = {"new": "like new", "factory new": "like new", "as new": "like new", "unfired": "like new", "mint": "like new", "near mint": "like new"}
CURIO_SAYS = r"c ?& ?r (?:eligible|ok|approved|firearm|qualified)|curio (?:and|&|or) relic|eligible for c ?& ?r"
CURIO_DENIES = r"not (?:a )?(?:c ?& ?r|curio)|non[ -]c ?& ?r|c ?& ?r ineligible"
REPRODUCTION = "reproduction|replica|modern copy|re-?creation"
NOTICES = "no returns|all sales (?:are )?final|shipping (?:restrictions|policy)|please (?:note|read)|we do not ship|check your local laws|must be shipped to|disclaimer"
DISCOUNT = r"(\d{1,2}) ?% off|\$ ?(\d+(?:\.\d\d)?) off|(free shipping)"


def sentences(text: Column) -> Column:
    """The sentences of a text, lower case, spaces collapsed."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?;\n]+"), lambda s: collapse_space(s)), lambda s: s != "")


def has(sentence: Column, words: str) -> Column:
    return sentence.rlike(rf"(?<![a-z]){'(?:' + words + ')'}(?![a-z])")


def denied(sentence: Column, claim: str) -> Column:
    """A denial at most REACH words before the claim, with no joint between them."""
    return sentence.rlike(rf"(?:(?<![a-z])(?:{DENIALS})|n't)(?:[ -]+(?!(?:{JOINTS})(?![a-z]))[\w']+){{0,{REACH}}}[ -]+(?:{claim})(?![a-z])")


def guess(sentence: Column, claim: str, hedges: str = HEDGES) -> Column:
    """The sentence only guesses, or talks of the model before it comes to the claim."""
    return has(sentence, hedges) | sentence.rlike(rf"(?<![a-z])(?:{GENERIC})(?![a-z]).*(?:{claim})")


@dataclass(frozen=True)
class Rule:
    """``claim`` makes the answer true, ``against`` (or a denied claim) false; ``first`` says which side wins."""

    claim: str
    against: str = ""
    true_first: bool = True
    hedges: str = HEDGES
    ignores: str = ""  # words near the claim that make it about something else

    def read(self, text: Column) -> Column:
        """``struct(value, quote)``; null and null if nothing is said."""
        found = sentences(text)

        def say(s: Column, pattern: str) -> Column:
            about = ~s.rlike(rf"(?<![a-z])(?:{self.ignores})(?![a-z])[^,;:]*(?:{pattern})|(?:{pattern})[^,;:]*?(?<![a-z])(?:{self.ignores})(?![a-z])") if self.ignores else F.lit(True)
            return has(s, pattern) & ~guess(s, pattern, self.hedges) & about

        yes = F.filter(found, lambda s: say(s, self.claim) & ~denied(s, self.claim))
        no = F.filter(found, lambda s: say(s, self.claim) & denied(s, self.claim))
        if self.against:
            no = F.concat(F.filter(found, lambda s: say(s, self.against)), no)
            yes = F.filter(yes, lambda s: ~has(s, self.against))
        sides = [(F.lit(True), yes), (F.lit(False), no)]
        out = F.lit(None).cast("struct<value:boolean,quote:string>")
        for value, side in sides if not self.true_first else sides[::-1]:
            out = F.when(F.size(side) > 0, F.struct(value.alias("value"), F.substring(F.get(side, F.lit(0)), 1, 140).alias("quote"))).otherwise(out)
        return F.coalesce(out, F.struct(F.lit(None).cast("boolean").alias("value"), F.lit(None).cast("string").alias("quote")))


#: Words by the part that they play in what is said of a gun's numbers.
ROLES = {
    "a": ["all"], "q": ["visible", "main", "primary", "numbered", "original", "serial"], "s": ["number", "numbers", "parts", "serials"],
    "v": ["are", "is", "appear", "appears", "to", "be", "bear"], "i": ["it", "one", "gun", "rifle", "pistol", "carbine", "revolver"], "m": ["match", "matches", "matched", "matching"],
    "n": ["non", "mis"], "k": ["not", "doesn't", "don't", "isn't", "aren't"], "f": ["force", "mostly"], "r": ["re"], "e": ["electro"], "p": ["pencil", "pencilled", "penciled"],
    "d": ["mismatch", "mismatched", "mismatching", "nonmatching"], "w": ["renumbered", "electropencilled", "electropenciled", "forcematched"],
    "x": ["bayonet", "bayonets", "holster", "holsters", "sling", "slings", "scabbard", "scabbards", "case", "cases", "box", "boxes", "target", "targets", "pouch", "pouches"], "h": ["shoulder", "cleaning"], "t": ["stock", "stocks", "rod", "rods"],
    "z": ["except", "minus"], "b": ["but"], "g": ["save"], "u": ["other"], "y": ["than"], "l": ["the", "for", "some"], "c": ["bore", "finish", "wear", "condition", "pitting", "rust", "patina", "bluing", "ding", "dings", "scratch"],
}


@dataclass(frozen=True)
class Numbers:
    """Whether a gun's numbers match, read from the parts that words play in a sentence.

    Every word becomes a letter (ROLES; any other is o, and what ends a clause a comma), so that the rules are short
    patterns over roles: a subject, perhaps a verb, and the complement. One mismatch wins over all matches. A mismatch of what came with
    the gun (its box, holster or bayonet) says nothing, whether the thing is named after or before it. An exception
    after a match spoils it, unless it is one to the condition.
    """

    match: str = "aq*s?v*m|q*sv*m|mq*s|iva?m"
    mismatch: str = "d|nm|ka?m|fm|rq|ep|w"
    #: Of the mismatches those that may be about what came with the gun, and such a thing up to two words later.
    loose: str = "d|nm"
    thing: str = "x|ht"
    exception: str = "(?:z|b(?=l)|gl|uy)l*+(?!c)"

    def roles(self, sentence: Column) -> Column:
        words = F.split(F.regexp_replace(F.regexp_replace(sentence, r"[,:()]", " , "), r"[\s-]+", " "), " ")
        known = F.create_map(*[F.lit(x) for role, listed in ROLES.items() for word in listed for x in (word, role)], F.lit(","), F.lit(","))
        return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(known[w], F.lit("o"))), "")

    def verdict(self, sentence: Column) -> Column:
        """True, false or null for one sentence."""
        roles = self.roles(sentence)
        # gone with a thing that came along: one that stands up to two words later, or before it in its clause or brackets
        rest = F.regexp_replace(roles, rf"(?:{self.loose})(?=[^,]{{0,2}}?(?:{self.thing}))", "")
        rest = F.regexp_replace(rest, rf"(?:{self.thing})[^,]{{0,4}},?[^,]{{0,2}}(?:{self.mismatch})", ",")
        against = rest.rlike(self.mismatch)
        claimed = roles.rlike(rf"(?<![nkf])(?:{self.match})")
        spoiled = roles.rlike(rf"(?:{self.match})[^,]{{0,10}}?{self.exception}")
        about = guess(sentence, "[a-z-]*match[a-z]*")
        refused = denied(sentence, "(?:all )?(?:serial )?(?:numbers? )?match(?:ing)?")
        return F.when(~about, F.when(against | claimed & (spoiled | refused), False).when(claimed, True))

    def read(self, text: Column) -> Column:
        """``struct(value, quote)``; null and null if nothing is said."""
        told = F.transform(sentences(text), lambda s: F.struct(self.verdict(s).alias("value"), F.substring(s, 1, 140).alias("quote")))
        first = lambda value: F.get(F.filter(told, lambda x: x["value"] == value), F.lit(0))
        return F.coalesce(first(False), first(True), F.struct(F.lit(None).cast("boolean").alias("value"), F.lit(None).cast("string").alias("quote")))


#: A mark anywhere wins over a denial; any mismatch wins over a match; refinishing wins over its denial.
TRAITS = {
    "import_marked": Rule(IMPORT_MARK),
    "numbers_match": Numbers(),
    "refinished": Rule(REFINISH, ORIGINAL_FINISH, hedges=f"{HEDGES}|{LOOKS}", ignores=WOOD),
}


def grade(word: Column) -> Column:
    """A condition word on the common scale; of a range the lower end."""
    plain = collapse_space(F.regexp_replace(F.regexp_replace(F.lower(word), r"\+| plus", " "), "[-]", " "))
    known = F.create_map(*[F.lit(x) for k, v in {**{g: g for g in GRADES}, **GRADE_SPELLINGS}.items() for x in (k, v)])
    places = F.filter(F.transform(F.split(plain, " to "), lambda w: F.array_position(F.array(*map(F.lit, GRADES)), known[w]).cast("int")), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.element_at(F.array(*map(F.lit, GRADES)), F.array_max(places)))


_GRADE = "(?:(?:excellent|very good|good|fair|poor) to )?(?:excellent|very good|good|fair|poor|like new|near mint|mint|factory new)"


def overall_grade(text: Column) -> Column:
    """The whole item's condition, where a sentence states it."""
    pattern = rf"(?:(?:overall|general) condition(?: is|:| of)?(?: in)? ({_GRADE})|(?<!bore )condition: ({_GRADE})|(?:is|are|in) (?:an? )?({_GRADE}) (?:overall |original |used )?condition)"
    hits = F.filter(F.transform(sentences(text), lambda s: F.when(~guess(s, "condition"), F.coalesce(*[F.nullif(F.regexp_extract(s, pattern, i), F.lit("")) for i in (1, 2, 3)]))), lambda w: w.isNotNull())
    return grade(F.get(hits, F.lit(0)))


def bore_grade(text: Column) -> Column:
    """The grade of the bore, from sentences that name it."""
    about = F.array_join(F.filter(sentences(text), lambda s: has(s, "bores?")), " ")
    return F.coalesce(*[F.when(has(about, g), F.lit(g)) for g in ("like new", "mint", "excellent", "very good", "bright", "good", "fair", "poor", "dark")])


def finish_percent(text: Column) -> Column:
    """How much of the finish is left: the lower end of a range, from 5 to 100."""
    low = F.lower(F.coalesce(text, F.lit("")))
    before = F.regexp_extract(low, r"(\d{1,3})(?: ?[-–] ?\d{1,3})? ?%\+?(?: of (?:its|the))?(?: original)?(?: factory)? (?:blue|bluing|finish|nickel|parkerizing)", 1)
    after = F.regexp_extract(low, r"original finish(?: rates?| remaining| is)?(?: roughly| about)? (\d{1,3})(?: ?[-–] ?\d{1,3})? ?%", 1)
    value = F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).cast("int")
    return F.when(value.between(5, 100), value)


_YEAR = r"(1[789]\d\d|20\d\d)"


def made(text: Column) -> Column:
    """``struct(first, last)`` of the stated years of making; of a circa decade its ten years; null without."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = rf"(?:made|manufactured|produced|built|dated|production)[^.;]{{0,30}}?{_YEAR}"
    span, decade, one = (F.regexp_extract(low, p, 1) for p in (rf"{said} ?(?:-|–|to|and) ?{_YEAR}", rf"(?:circa|ca\.?|c\.) ?{_YEAR}'?s", said))
    until = F.regexp_extract(low, rf"{said} ?(?:-|–|to|and) ?{_YEAR}", 2)
    return (
        F.when(span != "", F.struct(span.cast("int").alias("first"), until.cast("int").alias("last")))
        .when(decade != "", F.struct(decade.cast("int").alias("first"), (decade.cast("int") + 9).alias("last")))
        .when(one != "", F.struct(one.cast("int").alias("first"), one.cast("int").alias("last")))
    )


def curio(text: Column) -> Column:
    """``struct(stated, year)``: the vendor's word (a denial first), else the earliest year of an original."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stated = F.when(low.rlike(CURIO_DENIES), F.lit(False)).when(low.rlike(CURIO_SAYS), F.lit(True))
    dated = F.regexp_extract_all(low, F.lit(rf"(?:made|manufactured|produced|built|dated)[^.;]{{0,20}}?{_YEAR}"), 1)
    loose = F.regexp_extract_all(low, F.lit(rf"(?<![\w/-]|model |m ){_YEAR}(?![\w/-])"), 1)
    years = F.when(F.size(dated) > 0, dated).otherwise(loose)
    year = F.when(stated.isNull() & ~has(low, REPRODUCTION), F.array_min(F.transform(years, lambda y: y.cast("int"))))
    return F.struct(stated.alias("stated"), year.alias("year"))


def judged_year(manufacture_year: Column, made_to: Column, made_source: Column) -> Column:
    """The year that the age rule is judged on: a stated or tabled one, the listing's own, one placed by serial."""
    return F.coalesce(F.when(made_source.isin("stated", "table"), made_to), manufacture_year, F.when(made_source == "serial", made_to))


def verdict(stated: Column, year: Column, this_year: int, age: int = 50) -> Column:
    """eligible, not_eligible or unknown: the vendor's word, else the year against the moving cutoff."""
    by_age = F.when(year <= this_year - age, "eligible").when(year.isNotNull(), "not_eligible")
    return F.coalesce(F.when(stated, "eligible").when(~stated, "not_eligible"), by_age, F.lit("unknown"))


def barrel_inches(title: Column, description: Column) -> Column:
    """The length of the barrel in inches, a title's before a description's; millimetres are converted."""

    def one(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        number = r"(\d{1,2}(?:\.\d+)?(?:[ -]\d{1,2}/\d{1,2})?|\d{1,2}[½¼¾]?)"
        before = F.regexp_extract(low, rf"{number} ?-?(?:\"|”|''|in\.?|inch(?:es)?)[ -]*(?:\w+ ){{0,2}}?(?:barrel|bbl)", 1)
        after = F.regexp_extract(low, rf"(?:barrel|bbl)s?(?: length)?(?::| is| of|-)? ?{number} ?-?(?:\"|”|''|in\.?|inch)", 1)
        metric = F.concat(*[F.regexp_extract(low, r"(\d{2,3}) ?mm (?:barrel|bbl)|(?:barrel|bbl)(?: length)?(?::| of)? ?(\d{2,3}) ?mm", i) for i in (1, 2)])
        inches = F.coalesce(mixed_number(F.nullif(before, F.lit(""))), mixed_number(F.nullif(after, F.lit(""))))
        value = F.coalesce(inches, F.bround(F.nullif(metric, F.lit("")).cast("double") / 25.4, 1))
        return F.when(value.between(1.0, 50.0), value)

    return F.coalesce(one(title), one(description))


def capacity(title: Column, description: Column, most: int = 120) -> Column:
    """Rounds that an item holds: a title's first number of rounds, else a description's."""

    def one(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        found = F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (r"capacity(?::| of| is)? ?(\d{1,3})", r"(\d{1,3})[ -]?(?:rounds?|rds?|rnd|shot)\b", r"(\d{1,3})\+1\b")])
        return F.when(found.cast("int").between(1, most), found.cast("int"))

    return F.coalesce(one(title), one(description))


def threaded(text: Column) -> Column:
    """Whether the barrel is threaded, where a sentence says so or denies it; a thread protector says so too."""
    found = sentences(text)
    claim = r"threaded (?:barrel|muzzle|bbl)|(?:barrel|muzzle) is threaded|thread protector|threaded \d/\d+"
    yes = F.exists(found, lambda s: has(s, claim) & ~denied(s, claim))
    no = F.exists(found, lambda s: (has(s, claim) & denied(s, claim)) | has(s, "unthreaded|non-threaded"))
    return F.when(yes, F.lit(True)).when(no, F.lit(False))


def frame_size(title: Column) -> Column:
    """``full``, ``compact``, ``subcompact`` or ``micro`` by a title's word; the smallest one named."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(has(low, "micro"), "micro").when(has(low, "sub-?compact"), "subcompact").when(has(low, "compact"), "compact").when(has(low, "full[ -]?size"), "full")


def serial(text: Column) -> Column:
    """``struct(prefix, low, high)`` of a stated serial; hidden last digits (x or *) span all that they could be."""
    low = F.upper(F.coalesce(text, F.lit("")))
    pattern = r"SERIAL(?: (?:NUMBER|NO\.?|#))?(?: RANGE)?:? ?([A-Z]{0,3})-?(\d{2,8})([X*]{0,4})"
    prefix, digits, hidden = (F.regexp_extract(low, pattern, i) for i in (1, 2, 3))
    scale = F.pow(F.lit(10.0), F.length(hidden)).cast("long")
    first = digits.cast("long") * scale
    return F.when(digits != "", F.struct(prefix.alias("prefix"), first.alias("low"), (first + scale - 1).alias("high")))


def offer(text: Column) -> Column:
    """``struct(discount, code, personal)`` of a letter that offers something; null for one that does not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    discount = F.nullif(F.regexp_extract(low, f"({DISCOUNT})", 1), F.lit(""))
    code = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i:(?:promo |coupon |discount )?code):? *[\"“']?((?=[A-Z]*\d)[A-Z][A-Z0-9]{2,15})", 1), F.lit(""))
    personal = low.rlike("just for you|your (?:personal|exclusive|own) code|one[- ]time use")
    return F.when(discount.isNotNull() | code.isNotNull(), F.struct(discount.alias("discount"), code.alias("code"), personal.alias("personal")))


def offer_end(text: Column, sent: Column, zone: str = "America/New_York") -> Column:
    """When an offer ends: hours or days from the letter, or the end of a named day in the shop's zone, as UTC."""
    low = F.lower(F.coalesce(text, F.lit("")))
    amount = F.regexp_extract(low, r"(?:valid|good|next|only|for)[a-z ]{0,12}(\d{1,3}) (hour|day)s?", 1)
    unit = F.regexp_extract(low, r"(?:valid|good|next|only|for)[a-z ]{0,12}(\d{1,3}) (hour|day)s?", 2)
    seconds = amount.cast("long") * F.when(unit == "day", 86_400).otherwise(3_600)
    month, day = (F.regexp_extract(low, r"(?:through|until|ends?|expires?|by)[a-z ]{0,8} (\d{1,2})/(\d{1,2})", i) for i in (1, 2))
    named = F.try_to_timestamp(F.concat_ws("-", F.year(sent).cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    named = F.when(named < sent - F.make_dt_interval(days=F.lit(1)), F.add_months(named, 12).cast("timestamp")).otherwise(named)
    end = F.to_utc_timestamp(named + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59)), zone)
    return F.when(amount != "", F.timestamp_seconds(F.unix_seconds(sent) + seconds)).when(month != "", end)


def without_notices(text: Column, least: int = 40, share: float = 0.4, longest: int = 300) -> Column:
    """A description without the standing notices at its end; whole again if that would take too much.

    The last sentence that is no notice is the last one kept; a very long sentence is never a notice.
    """
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    notice = lambda s: (F.length(s) <= longest) & F.lower(s).rlike(NOTICES)
    last = F.array_max(F.transform(parts, lambda s, i: F.when(~notice(s), i + 1)))
    kept = F.array_join(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))), " ")
    fine = (F.length(kept) >= least) & (F.length(F.trim(text)) - F.length(kept) <= share * F.length(F.trim(text)))
    return F.when(text.isNull() | (F.size(parts) < 2) | ~fine, text).otherwise(kept)


@dataclass(frozen=True)
class Kinds:
    """Flags in order of precedence, and which kinds a row may be counted in besides its own."""

    order: tuple[str, ...] = ("suppressor", "black_powder", "carry", "police", "rifle", "pistol")
    also: dict[str, str] = field(default_factory=lambda: {"carry": "pistol"})

    def single(self) -> Column:
        """The first kind whose flag is set."""
        return F.coalesce(*[F.when(F.coalesce(F.col(f"is_{k}"), F.lit(False)), F.lit(k)) for k in self.order])

    def several(self, extra: Column) -> Column:
        """All kinds that a row counts in: its own, and the other one of its kind where ``extra`` holds."""
        own = self.single()
        other = F.coalesce(*[F.when((own == k) & F.coalesce(extra, F.lit(False)), F.lit(v)) for k, v in self.also.items()])
        return F.array_compact(F.array(own, other))


def trait_filter(chosen: dict[str, list[bool]]) -> Column:
    """Either answer within a trait, all of the traits: ``{"import_marked": [False], ...}``."""
    out = F.lit(True)
    for name, answers in chosen.items():
        out = out & F.coalesce(any_of([F.col(name) == F.lit(a) for a in answers]), F.lit(False))
    return out


def provenance(current: Column, source: Column, found: Column, found_source: str, mode: str = "fill") -> Column:
    """``struct(value, source)`` after a reading: ``fill`` only what is empty, ``claim`` anything but a vendor's word, ``respell`` keeps the source."""
    empty = current.isNull() | (current.cast("string") == "")
    new = F.struct(found.alias("value"), F.lit(found_source).alias("source"))
    old = F.struct(current.alias("value"), source.alias("source"))
    if mode == "respell":
        return F.when(found.isNotNull(), F.struct(found.alias("value"), source.alias("source"))).otherwise(old)
    take = found.isNotNull() & (empty if mode == "fill" else empty | (F.coalesce(source, F.lit("vendor")) != "vendor"))
    return F.when(take, new).otherwise(old)


def read_traits(rows: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """``rows`` with the tri-state traits, their quotes, the grade and the finish left."""
    text = F.concat_ws("\n", title, description)
    read = rows.withColumns({f"_{k}": rule.read(text) for k, rule in TRAITS.items()})
    values = {k: F.col(f"_{k}.value") for k in TRAITS} | {f"{k}_quote": F.col(f"_{k}.quote") for k in TRAITS}
    return read.withColumns(values | {"grade": overall_grade(text), "finish_percent": finish_percent(text)}).drop(*[f"_{k}" for k in TRAITS])
