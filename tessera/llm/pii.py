"""PII surrogates: detected entities get keyed replacements of their type, script, gender and format.

Everything is a DataFrame expression. Mentions are found by one pattern; a mention is an entity or, for a name, a title and
an entity for each word. An entity is what its mentions have in common (an e-mail address in lower case, a number's digits,
a name's word), so all mentions of it get the same surrogate wherever they stand. Surrogates come from SHA-256 of a secret
key, the type and the entity. In rounds, a surrogate that two entities of a type share, that another entity has already, or
that is itself an entity of the corpus is drawn anew for all but the first of them, until none is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

# Titles that show a gender, and names for surrogates by script ---------------------------------------
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος"]
NEUTRAL = ["Dr", "Prof"]
FIRST = {
    "LF": "Anna Clara Elena Flora Ines Julia Laura Lucia Maria Nina Nora Olivia Rosa Sara Sofia Vera".split(),
    "LM": "Adam Bruno David Emil Felix Hugo Ivan Jonas Leon Lukas Martin Oscar Paul Robert Simon Victor".split(),
    "LN": "Alex Andrea Charlie Dana Jamie Jordan Kim Luca Mika Noa Robin Sascha Sam Toni Val Yuki".split(),
    "CF": "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    "CM": "Антон Борис Виктор Григорий Денис Иван Кирилл Лев Максим Олег Павел Роман".split(),
    "CN": "Женя Саша Валя Слава Шура Паша".split(),
    "GF": "Άννα Ελένη Ειρήνη Ιωάννα Μαρία Σοφία Χριστίνα Δήμητρα".split(),
    "GM": "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σπύρος".split(),
    "GN": "Άρης Ρένα Φώτης Άλκη".split(),
}
SYLLABLES = {
    "L": "ba lo ri na ve ter man sol dor lin mar ken son vi tal ber".split(),
    "C": "ба ло ри на ве тер ман сол дор лин мар кен".split(),
    "G": "βα λο ρι να βε τερ μαν σολ δορ λιν μαρ κεν".split(),
}
ENDINGS = {"LF": "a", "LM": "o", "LN": "i", "CF": "а", "CM": "ий", "CN": "я", "GF": "α", "GM": "ος", "GN": "ι"}
LAST_ENDINGS = {"CF": "ова", "CM": "ов", "CN": "енко"}
# ---------------------------------------------------------------------------------------------------------------------

_titles = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=lambda t: (-len(t), t)))
EMAIL = r"(?<![\p{L}\p{N}_.+\-])[\p{L}\p{N}_.+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
HEX = r"(?<![\p{L}\p{N}])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,}(?![\p{L}\p{N}])"
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
NUMBER = r"(?<![\p{L}\p{N}])(?=\+?(?:[ .\-/()]{0,2}\d){9})\+?\(?\d++(?:[ .\-/()]{1,2}\d++)*+(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_titles})\.? \p{{Lu}}[\p{{L}}\-]+(?: \p{{Lu}}[\p{{L}}\-]+)?"
DETECT = "|".join((EMAIL, IP, HEX, ACCOUNT, NUMBER, NAME))


#: The round from which surrogates may be longer than their entity, as its format may have no free values left; the most rounds.
WIDER, ROUNDS = 5, 40


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _kind(mention: str) -> Column:
    m = F.col(mention)
    return (
        F.when(m.contains("@"), "EMAIL").when(m.rlike(rf"^{IP}$"), "IP").when(m.rlike("^[0-9a-f]{32,}$"), "HEX")
        .when(m.rlike(r"^[+\d .\-/()]+$"), "NUMBER").when(m.rlike(rf"^(?:{_titles})\.? "), "NAME").otherwise("ACCOUNT")
    )


def _parts() -> str:
    """Of (mention, kind): the entities as an array of (type, entity); a name's type holds script and gender."""
    script = r"CASE WHEN mention RLIKE '\\p{IsCyrillic}' THEN 'C' WHEN mention RLIKE '\\p{IsGreek}' THEN 'G' ELSE 'L' END"
    title = "regexp_replace(split(mention, ' ')[0], '[.]', '')"
    gender = f"CASE WHEN array_contains({_quoted(FEMALE)}, {title}) THEN 'F' WHEN array_contains({_quoted(MALE)}, {title}) THEN 'M' ELSE 'N' END"
    last = f"CASE WHEN ({script}) = 'C' THEN concat('LAST_C', {gender}) ELSE concat('LAST_', {script}, 'N') END"
    words = "transform(slice(split(mention, ' '), 2, 2), w -> lower(w))"
    return f"""CASE kind
        WHEN 'NAME' THEN transform({words}, (w, i) -> named_struct('type', CASE WHEN i = 0 AND size({words}) = 2 THEN concat('FIRST_', {script}, {gender}) ELSE {last} END, 'entity', w))
        WHEN 'NUMBER' THEN array(named_struct('type', kind, 'entity', regexp_replace(mention, '[^0-9]', '')))
        WHEN 'ACCOUNT' THEN array(named_struct('type', kind, 'entity', lower(replace(mention, ' ', ''))))
        ELSE array(named_struct('type', kind, 'entity', lower(mention))) END"""


def _drawn(n: str, i: str = "i") -> str:
    return f"pmod(xxhash64(seed, {i}), {n})"


def _luhn(s: str) -> str:
    digit = f"cast(substring({s}, length({s}) + 1 - i, 1) AS int)"
    return f"aggregate(sequence(1, length({s})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)"


def _drawn_anew(left: DataFrame, key: str, round_: int) -> DataFrame:
    """(type, entity, surrogate) of left(type, entity), as drawn in this round.

    What several formats share has a column of its own: Spark's parser keeps in the driver's heap what it learnt of long and
    deeply nested SQL, 30 MB where each format spells it out.
    """
    char = "substring(entity, i, 1)"
    digit = f"CASE WHEN i = 1 AND {char} <> '0' THEN 1 + {_drawn('9')} ELSE {_drawn('10')} END"

    def mapped(until: str, letters: str) -> str:
        letter = f"char(97 + {_drawn(letters)})"
        return f"array_join(transform(sequence(1, {until}), i -> CASE WHEN {char} RLIKE '[0-9]' THEN cast({digit} AS string) WHEN {char} RLIKE '[@_.+-]' THEN {char} ELSE {letter} END), '')"

    octet = f"CASE length(o) WHEN 1 THEN 1 + {_drawn('9')} WHEN 2 THEN 10 + {_drawn('90')} ELSE 100 + {_drawn('155')} END" if round_ < WIDER else _drawn("256")
    octets = f"array_join(transform(split(entity, '[.]'), (o, i) -> cast({octet} AS string)), '.')"
    more = min(9, round_ - WIDER + 2)
    longer = "''" if round_ < WIDER else f"lpad(cast({_drawn(str(10**more), '-1')} AS string), {more}, '0')"
    kind, card = F.col("type"), F.expr("type = 'NUMBER' AND length(entity) BETWEEN 13 AND 19")
    columns = {
        "seed": F.sha2(F.concat_ws("|", F.lit(key), F.lit(round_), "type", "entity"), 256),
        "longer": F.expr(longer),
        "top": F.expr("substring_index(entity, '.', -1)"),  # an address keeps its top-level domain
        "until": F.when(kind == "EMAIL", F.expr("length(entity) - length(top)")).when(kind.isin("HEX", "ACCOUNT", "NUMBER"), F.length("entity")),
        "letters": F.when(kind == "HEX", 6).otherwise(26),
        "body": F.when(F.col("until").isNotNull(), F.expr(mapped("until", "letters"))),
        "zeroed": F.when(card, F.expr("concat(substring(body, 1, length(entity) - 1), '0')")),
        "check": F.when(card, F.expr(f"pmod({_luhn('entity')} - {_luhn('zeroed')}, 10)")),
    }
    out = (
        F.when(kind == "EMAIL", F.concat("longer", "body", "top")).when(kind == "IP", F.expr(octets))
        .when(kind == "ACCOUNT", F.expr("concat(substring(entity, 1, 2), substring(body, 3), longer)"))
        .when(card, F.expr("concat(substring(body, 1, length(entity) - 1), cast(check AS string))")).when(kind.isin("HEX", "NUMBER"), F.concat("body", "longer"))
    )
    for script, syllables in SYLLABLES.items():
        some = lambda n, s=syllables: f"array_join(transform(sequence(1, {n}), i -> {_quoted(s)}[{_drawn(str(len(s)))}]), '')"
        for gender in "FMN":
            who, pool = script + gender, FIRST[script + gender]
            first = f"lower({_quoted(pool)}[{_drawn(str(len(pool)), '0')}])" if round_ < 2 else f"concat({some(round_)}, '{ENDINGS[who]}')"
            out = out.when(kind == f"FIRST_{who}", F.expr(first)).when(kind == f"LAST_{who}", F.expr(f"concat({some(3 + round_)}, '{LAST_ENDINGS.get(who, '')}')"))
    for name, column in columns.items():
        left = left.withColumn(name, column)
    return left.select("type", "entity", out.alias("surrogate"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate), written, of the distinct entities(type, entity).

    From round WIDER on, surrogates may take more characters than the entity (addresses: octets of any length), so that
    free values grow tenfold a round and few rounds are left however many entities share a format; an error after ROUNDS.
    """
    done, left, n = [], entities, 0
    while True:
        first = _drawn_anew(left, key, n).groupBy("type", "surrogate").agg(F.min("entity").alias("entity"))
        for taken in [entities.select("type", F.col("entity").alias("surrogate")), *(d.select("type", "surrogate") for d in done)]:
            first = first.join(taken, ["type", "surrogate"], "left_anti")
        done.append(written(first.select("type", "entity", "surrogate")))
        left = written(left.join(done[-1], ["type", "entity"], "left_anti"))
        n += 1
        if left.isEmpty():
            return written(reduce(DataFrame.union, done))
        if n == ROUNDS:
            raise ValueError(f"entities without a free surrogate after {ROUNDS} rounds")


def _shown() -> str:
    """SQL of a mention's replacement from (mention, kind, new): new has the surrogates of its entities in order."""
    at = "length(regexp_replace(substring(mention, 1, i), '[^0-9]', ''))"
    digits = f"array_join(transform(sequence(1, length(mention)), i -> CASE WHEN substring(mention, i, 1) RLIKE '[0-9]' THEN substring(new[0], {at}, 1) ELSE substring(mention, i, 1) END), '')"
    digits = f"concat({digits}, substring(new[0], 1 + length(regexp_replace(mention, '[^0-9]', ''))))"
    kept = "length(regexp_replace(substring(mention, 1, i), ' ', ''))"
    spaced = f"upper(array_join(transform(sequence(1, length(mention)), i -> CASE WHEN substring(mention, i, 1) = ' ' THEN ' ' ELSE substring(new[0], {kept}, 1) END), ''))"
    spaced = f"concat({spaced}, upper(substring(new[0], 1 + length(replace(mention, ' ', '')))))"
    cased = "array_join(transform(sequence(1, length(new[0])), i -> CASE WHEN substring(mention, i, 1) = lower(substring(mention, i, 1)) THEN substring(new[0], i, 1) ELSE upper(substring(new[0], i, 1)) END), '')"
    name = "concat_ws(' ', split(mention, ' ')[0], transform(new, (w, i) -> CASE WHEN split(mention, ' ')[i + 1] = upper(split(mention, ' ')[i + 1]) THEN upper(w) ELSE initcap(w) END))"
    return f"CASE kind WHEN 'NUMBER' THEN {digits} WHEN 'ACCOUNT' THEN {spaced} WHEN 'NAME' THEN {name} ELSE {cased} END"


def pseudonymised(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with the mentions in text replaced; count: the name of a column for their number.

    Null texts stay null, empty ones empty; a null doc_id is like any other; repeated rows are replaced alike; an empty
    table gives an empty result; columns of other names, whatever they are, pass through. Where a format has fewer free values
    than entities, some surrogates are longer than their entity. The same key gives the same surrogates for the same
    corpus; without it they can't be led back.
    """
    id_, map_, list_ = fresh(docs, "id", "map", "found")  # no column of docs
    docs_ = docs.withColumn(id_, F.xxhash64("doc_id", "text"))  # rows of one text share its mentions
    found = docs_.select(id_, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DETECT), F.lit(0)))).alias("mention"))
    found = written(found.distinct())
    mentions = found.select("mention").distinct().withColumn("kind", _kind("mention"))
    parts = written(mentions.select("mention", "kind", F.posexplode(F.expr(_parts())).alias("at", "part")).select("mention", "kind", "at", "part.*"))
    names = surrogates(written(parts.select("type", "entity").distinct()), key)
    new = parts.join(names, ["type", "entity"]).groupBy("mention", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("new"))
    shown = written(new.select("mention", "kind", F.col("new.surrogate").alias("new")).select("mention", F.expr(_shown()).alias("shown")))
    maps = found.join(shown, "mention").groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias(map_))
    joined = docs_.join(written(maps).hint("merge"), id_, "left")  # at any size the same, so that what it moves grows with the input
    joined = joined.withColumn(list_, F.when(F.col(map_).isNotNull(), F.regexp_extract_all("text", F.lit(DETECT), F.lit(0))))
    pieces = F.transform(F.split("text", DETECT, -1), lambda p, i: F.concat(p, F.coalesce(F.try_element_at(map_, F.get(list_, i)), F.get(list_, i), F.lit(""))))
    text = F.when(F.col(map_).isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, *([F.coalesce(F.size(list_), F.lit(0)).cast("long").alias(count)] if count else []))
