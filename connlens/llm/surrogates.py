"""Personal data replaced by surrogates.

Addresses, numbers and names are found by expressions. An entity is its type
and its normal form, whatever the spelling of a mention, so all mentions of one
entity get one surrogate. A surrogate is drawn with a key from the entity and a
number of the attempt: every letter or digit gives way to one of its own class,
a card number keeps whether its check digit is right, a name keeps its gender
and script. A value that collides time and again grows, so that no type runs out
of values. Then all entities are checked against each other and against all
originals: of those that share a surrogate one keeps it, the rest, and whatever
equals an original, are drawn again until none is left.

A type is the place of a word in a name, its gender where it has one, and its
script; words of names share one space whatever their type, so no two of them
get the same value, and a family name has one value for all its bearers.

Only entities drawn again need a look-up when texts are rewritten; all other
surrogates follow from the mention itself.

Defined results: a null text stays null and has no mention; a text without
personal data stays as it is; repeated rows are rewritten alike and stay as
many; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import fresh, quoted, saved, table, with_value
from connlens.operators.spread import spread_join

KEY = "connlens"
#: Entities looked up when texts are rewritten, and their bytes, up to which they are broadcast.
FEW, FEW_BYTES = 100_000, 8 << 20
#: Attempts after which a value grows, by one more letter, digit or syllable each. Kinds of a fixed length have far more
#: values and keep their format for longer.
GROWS, FIXED_GROWS = 3, 12

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d])(?!\.\d)"
PHONE = r"\+\d{1,3}\x20?\(\d{2,4}\)\x20?\d{3,4}[-.\x20]?\d{3,4}(?!\d)|\+\d{1,3}(?:[-.\x20]\d{2,4}){2,4}(?!\d)|\+\d{8,14}(?!\d)|\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[\x20-]\d{4}){3})(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Titles that tell the gender, and titles of any gender.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Dame", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Госпожа")
ANYONE = ("Mx", "Dr", "Prof", "Professor", "Доктор")
_TITLE = "|".join(sorted((*FEMALE, *MALE, *ANYONE), key=len, reverse=True))
#: A capital or a letter of a script without capitals, then letters; parts after an apostrophe belong to the word.
_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]*+(?:['’][\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]*+)*+"
#: One unit of a name: an initial or a word. Units are joined by a space or a hyphen, or stand side by side as initials do.
UNIT = rf"(?:\p{{Lu}}\.|{_WORD})"
_JOINED = rf"{UNIT}(?:-?{UNIT})*+"
_PARTICLE = r"(?:(?:von|van|der|den|zu|zum|di|da|del|della|de|du|la|le|el|al|bin|ibn|ter|ten)\x20)*+"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?\x20{_PARTICLE}{_JOINED}(?:\x20{_PARTICLE}{_JOINED}){{0,2}}+(?!\p{{L}})"
#: A unit of a name anywhere else in a text.
UNTITLED = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){UNIT}(?![\p{{L}}\p{{N}}])"
KINDS = (("email", EMAIL), ("address", ADDRESS), ("phone", PHONE), ("social", SOCIAL), ("card", CARD), ("name", NAME))
ANY = "|".join(f"(?:{regex})" for _, regex in KINDS)

GIVEN = {
    ("m", "latin"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Ida Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Артём Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Ева Зоя Ирина Кира Лидия Майя Нина Ольга".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va".split(),
    "greek": "βα βε γα γο δα δε δο κα κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το φα φε".split(),
    "arabic": "با بو دا دو را رو سا سو فا فو كا كو لا لو ما مو نا نو تا تو شا شو".split(),
    "hebrew": "בא בו גא גו דא דו לא לו מא מו נא נו רא רו שא שו תא תו".split(),
    "han": "安 白 成 达 恩 方 高 和 江 康 林 明 宁 平 庆 荣 山 天 文 新 云 泽 正 志".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 하 고 노 도 로 모 보 소 오 조 호 기 미 수 우".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па по ра ре ро са се та те то".split(),
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _kind(m: Column) -> Column:
    """Kind of a mention, by the one expression that it matches whole."""
    out = F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "address").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
    return out.when(m.rlike(r"^(?:\d{13,19}|\d{4}(?:[\x20-]\d{4}){3})$"), "card").when(m.rlike(r"^\p{Lu}"), "name").otherwise("phone")


def _name_units(m: Column) -> Column:
    """struct(g, w): the units of a name, and what stands between them, the title first."""
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.?\x20{_PARTICLE}", 0)
    rest = F.substr(m, F.length(title) + 1)
    return with_value(F.struct(title.alias("t"), rest.alias("r")), lambda x: F.struct(
        F.transform(F.split(x["r"], UNIT, -1), lambda g, i: F.when(i == 0, F.concat(x["t"], g)).otherwise(g)).alias("g"), F.regexp_extract_all(x["r"], F.lit(UNIT), F.lit(0)).alias("w")))


def _plain(w: Column) -> Column:
    """A unit as it is known: words of capitals alone have one."""
    return F.when((F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w)), F.initcap(w)).otherwise(w)


def _spelled(w: Column, value: Column) -> Column:
    """A unit's value in the capitals of a mention."""
    return F.when(w == _plain(w), value).otherwise(F.upper(value))


def _last_units(m: Column) -> Column:
    """Number of units of the last word of a name."""
    return F.size(F.regexp_extract_all(F.regexp_extract(m, r"[^\x20]+$", 0), F.lit(UNIT), F.lit(0)))


def _units(m: Column, kind: Column) -> Column:
    """array<struct(type, norm)> of a mention: one entity, or one for each word of a name."""
    digits = F.regexp_replace(m, r"[^0-9]", "")
    # The digits of a country stay: they stand before a plus sign in the normal form.
    country = F.regexp_extract(m, r"^\+(\d{1,3})(?!\d)", 1)
    phone = F.when(country != "", F.concat(country, F.lit("+"), F.substr(digits, F.length(country) + 1))).otherwise(digits)
    norm = F.when(kind == "email", F.lower(m)).when(kind == "address", m).when(kind == "phone", phone).otherwise(digits)
    gender = F.when(m.rlike(f"^(?:{'|'.join(FEMALE)})\\b"), "f").when(m.rlike(f"^(?:{'|'.join(MALE)})\\b"), "m").otherwise("n")

    # Units of the last word are of the family; particles belong to no unit.
    def typed(x: Column) -> Column:
        def unit(w: Column, i: Column) -> Column:
            script = F.lit("latin")
            for name in SYLLABLES:
                script = F.when(w.rlike(rf"\p{{Is{name.capitalize()}}}"), name).otherwise(script) if name != "latin" else script
            part = F.when(w.endswith("."), "initial").when(i >= x["first"], "family").otherwise(F.concat(F.lit("given-"), x["gender"]))
            return F.struct(F.concat_ws("-", part, script).alias("type"), _plain(w).alias("norm"))

        return F.transform(x["w"], unit)

    units = with_value(_name_units(m)["w"], lambda w: F.struct(w.alias("w"), (F.size(w) - _last_units(m)).alias("first"), gender.alias("gender")))
    return F.when(kind == "name", with_value(units, typed)).otherwise(F.array(F.struct(kind.alias("type"), norm.alias("norm"))))


def _lists(lists: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for name, values in lists.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values]))])


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number right when it follows ``body``."""
    chars = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: with_value(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _space(kind: Column) -> Column:
    """Entities of one space never share a value."""
    return F.when(kind.rlike("^(?:given|family|initial)-"), "name").otherwise(kind)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """Normal form of the surrogate of an entity at an attempt."""
    slow = kind.isin("card", "social", "address")
    part = F.substring_index(kind, "-", 1)
    of_name = part.isin("given", "family", "initial")
    given = F.coalesce(F.try_element_at(_lists({f"given-{g}-{script}": v for (g, script), v in GIVEN.items()}), kind), F.array().cast("array<string>"))
    facts = F.struct(
        F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512).alias("seed"),
        F.floor((attempt - 1) / F.when(slow, FIXED_GROWS).otherwise(GROWS)).cast("int").alias("grown"),
        F.when(kind == "phone", F.instr(norm, "+")).otherwise(0).alias("stays"),
        F.when(kind == "email", F.length(norm) - F.instr(F.reverse(norm), ".")).otherwise(F.length(norm)).alias("until"),
        F.when(of_name, F.element_at(_lists(SYLLABLES), F.substring_index(kind, "-", -1))).alias("pool"),
        F.when(of_name, given).alias("given"),
    )

    def drawn(x: Column) -> Column:
        def number(i: Column) -> Column:
            return F.conv(F.substr(x["seed"], F.pmod(i * 5, F.lit(124)) + 1, F.lit(5)), 16, 10).cast("long") + i

        def pick(values: Column, i: Column) -> Column:
            return F.get(values, F.pmod(number(i), F.size(values)).cast("int"))

        def several(n: Column, one) -> Column:
            return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise("")

        def digit(i: Column) -> Column:
            return F.pmod(number(i), F.lit(10)).cast("string")

        def letter(i: Column) -> Column:
            return F.substr(F.lit(LETTERS), F.pmod(number(i), F.lit(26)).cast("int") + 1, F.lit(1))

        def octet(i: Column) -> Column:
            return (F.pmod(number(i), F.lit(254)) + 1).cast("string")

        def grown(one) -> Column:
            return several(x["grown"], lambda j: one(j * 7 + 3))

        # A word of a name: a name of the list or a first letter, then syllables; without either four syllables more.
        listed = F.size(x["given"]) > 0
        head = F.when(listed, pick(x["given"], F.lit(0))).when(part == "initial", F.substr(pick(x["pool"], F.lit(0)), F.lit(1), F.lit(1))).otherwise("")
        least = F.when(~listed & (part != "initial"), 4).when(attempt > 0, 1).otherwise(0)
        word = F.initcap(F.concat(head, several(least + F.greatest(x["grown"], F.lit(0)), lambda j: pick(x["pool"], j))))

        def one(c: Column, i: Column) -> Column:
            kept = (i < x["stays"]) | (i >= x["until"])
            return F.when(kept, c).when(c.rlike("^[0-9]$"), digit(i)).when(c.rlike("^[a-z]$"), letter(i)).otherwise(c)

        chars = F.filter(F.split(norm, ""), lambda c: c != "")
        spelled = F.concat(F.when(kind == "email", grown(letter)).otherwise(""), F.array_join(F.transform(chars, one), ""), F.when(kind == "email", "").otherwise(grown(digit)))

        def card(value: Column) -> Column:
            body = F.substr(value, F.lit(1), F.length(value) - 1)
            right = F.substr(norm, F.length(norm), F.lit(1)).cast("int") == _check_digit(F.substr(norm, F.lit(1), F.length(norm) - 1))
            return F.when(right, F.concat(body, _check_digit(body).cast("string"))).otherwise(value)

        octets = F.concat(F.array_join(F.transform(F.split(norm, r"\."), lambda _, i: octet(i)), "."), grown(lambda j: F.concat(F.lit("."), octet(j))))
        named = F.when(part == "initial", F.concat(word, F.lit("."))).otherwise(word)
        return F.when(of_name, named).when(kind == "card", with_value(spelled, card)).when(kind == "address", octets).otherwise(spelled)

    return with_value(facts, drawn)


def _shown(m: Column, kind: Column, values: Column) -> Column:
    """A mention rewritten: its own marks and capitals, the surrogate's letters and digits."""
    value = F.element_at(values, 1)

    def characters(text: Column) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    def numbered(x: Column) -> Column:
        # A text between two digits follows the digit before it; what a value has grown by follows the last digit.
        digits = F.transform(x["gaps"], lambda g, i: F.concat(F.when(i == 0, "").when(i < F.size(x["gaps"]) - 1, F.get(x["value"], i - 1)).otherwise(F.array_join(F.slice(x["value"], i, F.greatest(F.size(x["value"]), F.lit(1))), "")), g))
        return F.array_join(digits, "")

    def lettered(x: Column) -> Column:
        # What a value has grown by stands before an address.
        ahead = F.size(x["value"]) - F.size(x["own"])
        letters = F.transform(x["own"], lambda c, i: with_value(F.get(x["value"], ahead + i), lambda v: F.when(c.rlike("^[A-Z]$"), F.upper(v)).otherwise(v)))
        return F.concat(F.array_join(F.slice(x["value"], 1, F.greatest(ahead, F.lit(0))), ""), F.array_join(letters, ""))

    number = with_value(F.struct(F.split(m, "[0-9]", -1).alias("gaps"), characters(F.replace(value, F.lit("+"), F.lit(""))).alias("value")), numbered)
    mail = with_value(F.struct(characters(m).alias("own"), characters(value).alias("value")), lettered)
    name = with_value(_name_units(m), lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(_spelled(F.get(x["w"], i), F.get(values, i)), F.lit("")))), ""))
    return F.when(kind == "email", mail).when(kind == "address", value).when(kind == "name", name).otherwise(number)


def _label(unit: Column) -> Column:
    return F.concat_ws("|", unit["type"], unit["norm"])


def units_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, type, norm): the entities of each text, named by its hash, each once."""
    found = docs.select(quoted(text).alias("t")).filter(F.col("t").rlike(ANY)).select(F.xxhash64("t").alias("h"), F.explode(F.regexp_extract_all("t", F.lit(ANY), F.lit(0))).alias("m"))
    units = found.select("h", F.explode(_units(F.col("m"), _kind(F.col("m")))).alias("u"))
    return units.select("h", "u.type", "u.norm").distinct()


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, norm), each once."""
    return units_of(docs, text).select("type", "norm").distinct()


def assigned(found: DataFrame, key: str = KEY) -> DataFrame:
    """(type, norm, attempt, value): distinct values within a space, none of them an original of it.

    A round draws values for those entities alone that lost the one before. Of
    those that draw a value at once, and none has it yet, the first keeps it.
    Values grow with the attempts, so the rounds end.
    """
    found = saved(found.select(_space(F.col("type")).alias("space"), "type", "norm"), "entities")
    taken = found.select("space", F.col("norm").alias("value"))
    losers, kept, attempt = found, [], 0
    while attempt == 0 or losers.limit(1).count():
        drawn = saved(losers.withColumn("value", surrogate(F.col("type"), F.col("norm"), F.lit(attempt), key)), "drawn")
        free = drawn.join(taken, ["space", "value"], "left_anti")
        first = free.groupBy("space", "value").agg(F.min(F.struct("type", "norm")).alias("owner"))
        won = saved(first.select("space", "owner.type", "owner.norm", F.lit(attempt).alias("attempt"), "value"), "surrogates")
        losers = saved(drawn.drop("value").join(won.select("type", "norm"), ["type", "norm"], "left_anti"), "losers")
        taken = taken.unionByName(won.select("space", "value"))
        kept.append(won.drop("space"))
        attempt += 1
    out = kept[0]
    for won in kept[1:]:
        out = out.unionByName(won)
    return out


def _few(df: DataFrame, size: Column) -> bool:
    """Whether a frame is small enough in rows and bytes to be broadcast."""
    facts = df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return facts["n"] <= FEW and (facts["bytes"] or 0) <= FEW_BYTES


def _dealt(names: Column) -> Column:
    """'norm|value' texts dealt by a hash of the norm to about as many arrays as the root of their number."""
    n = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(names))).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(names, lambda x: F.pmod(F.xxhash64(F.substring_index(x, "|", 1)), n) == b))


def _untitled(gap: Column, known: Column) -> Column:
    """struct(g, w) of a text between mentions: its capitalised words, with their values where they are a known name; a word of two genders or places has that of the first mention."""

    def one(w: Column) -> Column:
        norm = F.concat(_plain(w), F.lit("|"))
        held = F.filter(F.get(known, F.pmod(F.xxhash64(_plain(w)), F.size(known)).cast("int")), lambda x: x.startswith(norm))
        return with_value(F.get(held, F.lit(0)), lambda x: F.struct(F.when(x.isNotNull() & (F.length(w) > 1), "name").alias("kind"), w.alias("original"), F.when(F.length(w) > 1, F.coalesce(_spelled(w, F.substr(x, F.length(norm) + 1)), w)).otherwise(w).alias("value")))

    return F.struct(F.split(gap, UNTITLED, -1).alias("g"), F.transform(F.regexp_extract_all(gap, F.lit(UNTITLED), F.lit(0)), one).alias("w"))


def replaced(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and a column array<struct(kind, start, value)> of the mentions."""
    units = saved(units_of(docs, text), "units")
    again = saved(assigned(units.select("type", "norm").distinct(), key).filter("attempt > 0").select(_label(F.struct("type", "norm")).alias("label"), "attempt"), "again")
    tries, h = fresh(docs, "_tries"), fresh(docs, "_h")
    if again.limit(1).count():
        labelled = units.select("h", _label(F.struct("type", "norm")).alias("label"))
        met = labelled.join(F.broadcast(again), "label") if _few(again, F.length("label")) else spread_join(labelled, again, "label", "inner")
        side = saved(met.groupBy(F.col("h").alias(h)).agg(F.map_from_entries(F.collect_list(F.struct("label", "attempt"))).alias(tries)), "tries")
        rows = docs.withColumn(h, F.xxhash64(quoted(text)))
        small = _few(side, F.length(F.array_join(F.map_keys(quoted(tries)), "")))
        # A text may have many copies: beyond a broadcast their rows are dealt to many tasks.
        rows = (rows.join(F.broadcast(side), h, "left") if small else spread_join(rows, side, h, "left")).drop(h)
    else:
        rows = docs.withColumn(tries, F.lit(None).cast("map<string,int>"))
    value = quoted(text)
    parts = F.struct(F.split(value, ANY, -1).alias("g"), F.regexp_extract_all(value, F.lit(ANY), F.lit(0)).alias("w"))

    def mention(m: Column) -> Column:
        kind = _kind(m)
        units = _units(m, kind)
        values = F.transform(units, lambda u: surrogate(u["type"], u["norm"], F.coalesce(F.try_element_at(quoted(tries), _label(u)), F.lit(0)), key))
        names = F.when(kind == "name", F.transform(units, lambda u, i: F.concat(u["norm"], F.lit("|"), F.get(values, i)))).otherwise(F.array().cast("array<string>"))
        return F.struct(kind.alias("kind"), m.alias("m"), _shown(m, kind, values).alias("value"), names.alias("names"))

    made = fresh(rows, "_made")
    rows = rows.withColumn(made, F.when(value.rlike(ANY), with_value(parts, lambda x: F.struct(x["g"].alias("g"), F.transform(x["w"], mention).alias("w")))))
    # Untitled mentions of the names found in the same text, looked up among the text's own names by a hash.
    known = with_value(F.array_distinct(F.flatten(F.transform(quoted(made)["w"], lambda w: w["names"]))), _dealt)
    rest = fresh(rows, "_rest")
    plain = F.transform(quoted(made)["g"], lambda g: F.struct(F.array(g).alias("g"), F.array().cast("array<struct<kind:string,original:string,value:string>>").alias("w")))
    again_of = with_value(known, lambda b: F.transform(quoted(made)["g"], lambda g, i: _untitled(g, b)))
    rows = rows.withColumn(rest, F.when(F.exists(quoted(made)["w"], lambda w: w["kind"] == "name"), again_of).otherwise(plain))
    joined = F.array_join(F.transform(quoted(rest), lambda x, i: F.concat(
        F.array_join(F.transform(x["g"], lambda g, j: F.concat(g, F.coalesce(F.get(x["w"], j)["value"], F.lit("")))), ""), F.coalesce(F.get(quoted(made)["w"], i)["value"], F.lit("")))), "")
    mentions = F.flatten(F.transform(quoted(rest), lambda x, i: F.concat(
        F.filter(x["w"], lambda w: w["kind"] == "name"), F.transform(F.slice(quoted(made)["w"], i + 1, 1), lambda w: F.struct(w["kind"].alias("kind"), w["m"].alias("original"), w["value"].alias("value"))))))
    found = F.coalesce(mentions, F.array().cast("array<struct<kind:string,original:string,value:string>>"))
    kept = [F.coalesce(joined, value).alias(text) if c == text else quoted(c) for c in docs.columns]
    return rows.select(*kept, found.alias(fresh(docs, "mentions")))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.transform("mentions", lambda m: m["kind"]), ",")
    return out.select("doc_id", "text", F.size("mentions").cast("long").alias("n_mentions"), kinds.alias("kinds"))
