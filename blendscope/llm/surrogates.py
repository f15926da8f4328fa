"""Personal data replaced by keyed surrogates (DataFrame operations only).

E-mail and IP addresses, payment card and phone numbers, account numbers and titled names are found in whole texts.
Each distinct entity gets one surrogate, derived from a keyed digest of its canonical form, so all its spellings in all
documents are replaced alike. Surrogates keep type, script, case and format: letters become letters of the same script
and case (Latin ones where the script is not listed), digits digits, separators stay; card numbers keep a valid check
digit, names the gender of their title. Surrogates that collide with each other or with an entity of the corpus are
derived again, longer with each fourth attempt, so that a free one exists however many entities there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendscope.llm.shared import discard, stored

#: Titles by gender, particles, and the words of a name (initials, hyphens, apostrophes, inner capitals).
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Dame|Frau|Madame|Mademoiselle|Mme|Mlle|Se\xF1ora|Se\xF1orita|Sra|Srta|Signora|Госпожа|[Гг]-жа"
MALE = "Mr|Sir|Lord|Herrn?|Monsieur|Se\xF1or|Sr|Signor|Господин|[Гг]-н"
TITLES = f"(?:(?:{FEMALE}|{MALE}|Mx|Dr|Prof|Professor|Doctor|Doktor|Rev|Reverend|Capt|Captain|Доктор|Профессор)\\.? ){{1,4}}"
PARTICLES = r"(?:(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|zu|bin|ibn|al|el) ){0,3}"
WORD = PARTICLES + r"(?:\p{Lu}\. ?){0,3}" + PARTICLES + r"\p{Lu}(?:[\p{L}\p{M}]+|(?=['\u2019-]\p{L}))(?:['\u2019-](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*){0,8}"
HEX = "[0-9A-Fa-f]{1,4}"
#: What is taken for an entity, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "phone": r"(?<![\d+(])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|0\d(?:[ .-]\d{2}){4}"
             r"|\+(?=(?:[ .()-]{0,2}\d){8,15}(?![.-]?\d))\d{1,3}(?:[ .-]?\(?\d{1,12}\)?){1,6})(?![.-]?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}(?::{HEX}){{0,6}})?::(?:{HEX}(?::{HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "name": rf"(?<!\p{{L}}){TITLES}{WORD}(?: {WORD}){{0,2}}(?![\p{{L}}\p{{M}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these has no entity.
HINT = rf"[@0-9]|(?<!\p{{L}}){TITLES}"
TITLE = f"^{TITLES}"

#: Given names by gender and script.
NAMES = {
    "latin m": "Adam Bruno Carlo David Emil Felix Georg Henri Ivan Jonas Karl Lukas Marco Nils Oscar Pablo".split(),
    "latin f": "Alma Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Marta Nora Olga Paula".split(),
    "cyrillic m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    "cyrillic f": "Анна Вера Галина Дарья Елена Ирина Ксения Мария".split(),
}
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo na".split(), "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на".split()}
#: Replacements by script, upper or lower case; the first pattern that fits counts. Letters of other scripts become Latin
#: letters, other numbers ASCII digits, combining marks go with the letter they belonged to.
LETTERS = [(r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\d", "0123456789"),
           (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшщэюя"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
           (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
           (r"[\p{IsArmenian}&&\p{Ll}]", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"), (r"[\p{IsArmenian}&&\p{Lu}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ"),
           (r"[\p{IsLatin}&&\p{Ll}]", "àáâäåæçèéêëíîïñòóôöøùúûü"), (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÅÆÇÈÉÊËÍÎÏÑÒÓÔÖØÙÚÛÜ"),
           (r"\p{IsHan}", "丁三上下中久云五京仁今仙任伊伍会佐余作何冬冰几刘北十千卓南卢叶司吉吕吴周"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
           (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주"),
           (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"[\p{IsHebrew}&&\p{L}]", "אבגדהוזחטיכלמנסעפצקרשת"), (r"[\p{IsDevanagari}&&\p{L}]", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
           (r"[\p{IsBengali}&&\p{L}]", "কখগঘচছজঝটঠডঢতথদধনপফবভমযরলশষসহ"), (r"[\p{IsTamil}&&\p{L}]", "கஙசஞடணதநபமயரலவழளறன"), (r"[\p{IsTelugu}&&\p{L}]", "కఖగఘచఛజఝటఠడఢతథదధనపఫబభమయరలవశషసహ"),
           (r"[\p{IsThai}&&\p{L}]", "กขคงจฉชซญดตถทธนบปผฝพฟมยรลวสหอฮ"), (r"[\p{IsGeorgian}&&\p{L}]", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
           (r"[\u0660-\u0669]", "٠١٢٣٤٥٦٧٨٩"), (r"[\u06F0-\u06F9]", "۰۱۲۳۴۵۶۷۸۹"), (r"[\u0966-\u096F]", "०१२३४५६७८९"), (r"[\uFF10-\uFF19]", "０１２３４５６７８９"),
           (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789"), (r"\p{M}", "")]


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(number: Column) -> Column:
    """Sum of the check-digit rule over a string of digits."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def kind_of(raw: Column) -> Column:
    """Type of a found string, null if it is none after all (a card number without a valid check digit)."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        fits = F.regexp_like(raw, F.lit(f"^(?:{pattern})$"))
        if kind == "card":
            fits = fits & (luhn_sum(digits(raw)) % 10 == 0)
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def gender_of(raw: Column) -> Column:
    """Gender of a name's titles, n if they have none."""
    title = F.regexp_extract(raw, TITLE, 0)
    return F.when(F.regexp_like(title, F.lit(rf"(?:^| )(?:{FEMALE})\.? ")), F.lit("f")).when(F.regexp_like(title, F.lit(rf"(?:^| )(?:{MALE})\.? ")), F.lit("m")).otherwise(F.lit("n"))


def bare_name(raw: Column) -> Column:
    """Lower-case name without titles and particles."""
    spaced = F.regexp_replace(F.regexp_replace(raw, TITLE, ""), r"\. ?", ". ")
    return F.lower(F.regexp_replace(spaced, rf"(?<!\S){PARTICLES}", ""))


def canonical(kind: Column, raw: Column) -> Column:
    """One form for all spellings of an entity: digits of numbers, lower case of addresses and names without title."""
    number = digits(raw)
    return (
        F.when(kind.isin("card", "ssn"), number)
        .when(kind == "phone", F.regexp_replace(number, r"^1(?=\d{10}$)", ""))
        .when(kind == "iban", F.upper(F.regexp_replace(raw, " ", "")))
        .when(kind == "name", F.concat(gender_of(raw), F.lit(" "), bare_name(raw)))
        .otherwise(F.lower(raw))
    )


def draw(digest: Column, i: Column, n: int | Column) -> Column:
    """The i-th keyed number below n (16 bits each, repeating after a digest's 16)."""
    return (F.conv(F.substr(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def scrambled(word: Column, digest: Column) -> Column:
    """``word`` with every letter and digit replaced by one of its script and case."""
    def other(c, i):
        letters = F.lit(None).cast("string")
        for pattern, some in reversed(LETTERS):
            letters = F.when(F.regexp_like(c, F.lit(f"^{pattern}$")), F.lit(some)).otherwise(letters)
        return F.when(letters.isNull(), c).when(letters == "", letters).otherwise(F.substr(letters, draw(digest, i, F.length(letters)) + 1, F.lit(1)))

    return F.array_join(F.transform(F.split(word, ""), other), "")


def drawn(letters: str, digest: Column, n: Column) -> Column:
    """``n`` keyed characters of ``letters``, independent of those that ``scrambled`` draws."""
    further = F.sha2(F.concat(F.lit("more"), digest).cast("binary"), 256)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.lit(letters), draw(further, i, len(letters)) + 1, F.lit(1))), "")).otherwise(F.lit(""))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str, base: Column | None = None) -> Column:
    """Replacement of the canonical form, longer with each fourth attempt: numbers get digits more, addresses letters.
    ``base`` is the surrogate of a full name's family."""
    base = F.lit(None).cast("string") if base is None else base
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 256)
    grow = F.floor(attempt / 4).cast("int")
    more = drawn("0123456789", digest, grow)
    number = F.concat(F.substr(canon, F.lit(1), F.lit(1)), more, scrambled(F.substr(canon, F.lit(2)), digest))
    bare = F.substr(number, F.lit(1), F.length(number) - 1)
    check = (10 - luhn_sum(F.concat(bare, F.lit("0"))) % 10) % 10
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: draw(digest, i, 256).cast("string")), ".")
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lower(F.conv(draw(digest, i, 65536).cast("string"), 10, 16))), ":")
    block = F.when(grow == 0, F.lit("10.")).otherwise(F.concat((240 + draw(digest, F.lit(0), 16)).cast("string"), F.lit(".")))  # private, then reserved
    cyrillic = F.regexp_like(canon, F.lit(r"[а-яё]"))
    gender = F.substr(canon, F.lit(1), F.lit(1))

    def family(script: str) -> Column:
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + grow), lambda i: F.element_at(literal(SYLLABLES[script]), draw(digest, i, 16) + 1)), ""))

    def given(script: str) -> Column:
        men, women = NAMES[f"{script} m"], NAMES[f"{script} f"]
        first = F.when(gender == "m", F.element_at(literal(men), draw(digest, F.lit(0), len(men)) + 1)).when(
            gender == "f", F.element_at(literal(women), draw(digest, F.lit(0), len(women)) + 1)).otherwise(
            F.element_at(literal(men + women), draw(digest, F.lit(0), len(men + women)) + 1))
        return F.when(attempt == 0, first).otherwise(F.concat(first, F.lit("-"), family(script)))  # few given names, so a second one

    def part(word: Column, digest: Column) -> Column:
        """``word`` scrambled, or a new one if nothing in it can be."""
        return F.when(F.regexp_like(word, F.lit(r"[\p{L}\p{N}]")), scrambled(word, digest)).otherwise(drawn(LETTERS[0][1], digest, F.lit(6)))

    user, host = F.regexp_extract(canon, r"^(.*)@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
    return (
        F.when(kind == "card", F.concat(bare, check.cast("string")))
        .when(kind.isin("phone", "ssn"), F.concat(scrambled(canon, digest), more))
        .when(kind == "iban", F.concat(F.substr(canon, F.lit(1), F.lit(2)), scrambled(F.substr(canon, F.lit(3)), digest), more))
        .when(kind == "ip", F.when(grow < 4, F.concat(block, octets)).otherwise(F.concat(F.lit("2001:db8:"), groups)))  # no free IPv4 address
        .when(kind == "ipv6", F.concat(F.lit("2001:db8:"), groups))
        .when(kind == "family", F.when(cyrillic, family("cyrillic")).otherwise(family("latin")))
        .when(kind == "name", F.concat(F.when(cyrillic, given("cyrillic")).otherwise(given("latin")), F.lit(" "), base))
        .otherwise(F.concat(drawn(LETTERS[0][1], digest, grow), part(user, digest), F.lit("@"), part(host, F.sha2(digest.cast("binary"), 256)),
                            F.regexp_extract(canon, r"(\.[^.]*)$", 1)))
    )


def in_format(kind: Column, raw: Column, canon: Column, sur: Column) -> Column:
    """The surrogate written the way ``raw`` was: its separators, its country prefix, its title, its capitals. What is
    longer than ``raw`` follows at the end of a number and stands in front of an address."""
    prefix = F.substr(digits(raw), F.lit(1), F.length(digits(raw)) - F.length(canon))
    source = F.concat(F.when(kind == "phone", prefix).otherwise(F.lit("")), sur)
    slots = F.when(kind == "iban", F.lit(r"[A-Z0-9]")).otherwise(F.lit(r"\d"))
    slotted = F.aggregate(
        F.split(raw, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(F.regexp_like(c, slots), F.struct(F.concat(s["out"], F.substr(source, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
    )
    filled = F.concat(slotted["out"], F.substr(source, slotted["i"]))
    shown = F.when(raw == F.upper(raw), F.upper(sur)).otherwise(sur)
    cased = F.reverse(F.array_join(F.zip_with(F.split(F.reverse(raw), ""), F.split(F.reverse(sur), ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), ""))
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), filled)
        .when(kind.isin("name", "family"), F.concat(F.regexp_extract(raw, TITLE, 0), sur))
        .when(kind == "email", cased)
        .otherwise(shown)
    )


def surrogate_table(entities: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """Stored ``kind, canon, sur`` of distinct entities (``kind, canon, base``): no two of a kind share a surrogate, and no
    surrogate is an entity. Entities that clash (all but the smallest) are derived again with the next attempt."""
    def derived(df: DataFrame) -> DataFrame:
        return df.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key, F.col("base")))

    state = stored(derived(entities.withColumn("attempt", F.lit(0))), "surrogates")
    taken = entities.select("kind", F.when(F.col("kind") == "name", F.substr("canon", F.lit(3))).otherwise(F.col("canon")).alias("form")).distinct()
    for _ in range(rounds):
        first = state.groupBy("kind", "sur").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        form = F.when(F.col("kind") == "iban", F.col("sur")).otherwise(F.lower("sur"))
        marked = (
            state.withColumn("form", form).join(taken.withColumn("real", F.lit(True)), ["kind", "form"], "left")
            .join(first, ["kind", "sur"], "left")
            .withColumn("again", F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(F.col("canon") != F.col("first"), F.lit(False)))
        )
        after = stored(derived(marked.select("kind", "canon", "base", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again")), "surrogates")
        settled = after.filter("again").limit(1).count() == 0
        discard(state)
        state = after.drop("again")
        state.stored_at = after.stored_at
        if settled:
            return state.select("kind", "canon", "sur")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` sanitised and ``n_entities``, the number of entities replaced in it.

    Every occurrence in the whole text is replaced at its place, so a surrogate is never searched again. Texts without
    entities, null and empty texts come back as they are with 0. Equal texts are treated once. The key is secret: with
    another key all surrogates differ. An input column ``n_entities`` is replaced.
    """
    raw, kind, body = F.col("raw"), F.col("kind"), F.col(text)
    hint = F.coalesce(F.regexp_like(body, F.lit(HINT)), F.lit(False))
    found = (
        docs.filter(hint).select(F.md5(body.cast("binary")).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))).alias("raw"))
        .groupBy("id", "raw").agg(F.lit(1).alias("one")).select("id", "raw", kind_of(raw).alias("kind")).filter("kind is not null")
        .withColumn("canon", canonical(kind, raw))
    )
    bare, family = F.substr("canon", F.lit(3)), F.regexp_extract("canon", r"(\S+)$", 1)
    found = stored(found.withColumn("kind", F.when((kind == "name") & ~F.contains(bare, F.lit(" ")), F.lit("family")).otherwise(kind))
                   .withColumn("canon", F.when(kind == "family", bare).otherwise(F.col("canon"))), "entities")
    full = found.filter("kind = 'name'")
    owners = full.groupBy(bare.alias("bare")).agg(F.min(F.substr("canon", F.lit(1), F.lit(1))).alias("g"))  # f, m, then n
    full = full.withColumn("bare", bare).join(owners, "bare").withColumn("canon", F.when(F.col("canon").startswith("n "), F.concat("g", F.lit(" "), "bare")).otherwise(F.col("canon")))
    found = found.filter("kind <> 'name'").unionByName(full.select(found.columns))
    people = found.filter("kind in ('name', 'family')").select(F.lit("family").alias("kind"), family.alias("canon")).distinct()
    families = surrogate_table(people.withColumn("base", F.lit(None).cast("string")), key)
    of_family = families.select(F.col("canon").alias("family"), F.col("sur").alias("base"))
    rest = found.filter("kind <> 'family'").select("kind", "canon").distinct().withColumn("family", F.when(kind == "name", family))
    table = surrogate_table(rest.join(of_family, "family", "left").select("kind", "canon", "base"), key).unionByName(families)
    plain, sur = F.regexp_replace("raw", TITLE, ""), F.col("sur")  # names are also replaced where their title is missing
    forms = F.when(kind.isin("name", "family"), F.array(
        F.struct(plain.alias("raw"), sur.alias("new"), F.lit(True).alias("mention")),
        F.struct(F.regexp_extract(plain, r"([^ .]+)$", 1).alias("raw"), F.regexp_extract(sur, r"(\S+)$", 1).alias("new"), F.lit(True).alias("mention")))
    ).otherwise(F.array().cast("array<struct<raw:string,new:string,mention:boolean>>"))
    spelled = F.struct("raw", in_format(kind, raw, F.col("canon"), sur).alias("new"), F.lit(False).alias("mention"))
    change = F.struct("raw", "new")
    changes = (
        found.join(table, ["kind", "canon"]).select("id", F.inline(F.concat(F.array(spelled), forms)))
        .groupBy("id", "raw").agg(F.min("new").alias("new"), F.max("mention").alias("mention"))
        .groupBy("id").agg(F.map_from_entries(F.collect_list(change)).alias("changes"), F.collect_list(F.when(F.col("mention"), F.col("raw"))).alias("mentions"))
    )  # one map per distinct text, of its own entities
    longest = F.reverse(F.array_sort(F.transform("mentions", lambda m: F.struct(F.length(m).alias("n"), m.alias("m")))))
    changes = changes.withColumn("search", F.when(F.size("mentions") > 0, F.concat(
        F.lit(ANY + r"|(?<![\p{L}\p{M}])(?:\Q"), F.array_join(F.transform(longest, lambda x: x["m"]), r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{M}]|-\p{L})"))))
    mark = f"_{uuid.uuid4().hex}"
    changes = changes.select(F.col("id").alias(f"{mark}_id"), F.col("changes").alias(f"{mark}_changes"), F.col("search").alias(f"{mark}_search"))
    search = F.coalesce(F.col(f"{mark}_search"), F.lit(ANY))
    map_of, parts, hits = F.col(f"{mark}_changes"), F.split(body, search, -1), F.regexp_extract_all(body, search, F.lit(0))
    new = F.array_join(F.zip_with(parts, hits, lambda p, r: F.concat(p, F.coalesce(map_of[r], r, F.lit("")))), "")
    count = F.size(F.filter(hits, lambda r: F.map_contains_key(map_of, r))).cast("long")

    def result(df: DataFrame, changed: Column, n: Column) -> DataFrame:
        kept = [c for c in docs.columns if c.lower() != "n_entities"]
        return df.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in kept], n.alias("n_entities"))

    some = docs.filter(hint).withColumn(f"{mark}_id", F.md5(body.cast("binary"))).join(changes, f"{mark}_id", "left")  # only these move
    changed = result(some, F.when(map_of.isNotNull(), new).otherwise(body), F.when(map_of.isNotNull(), count).otherwise(F.lit(0).cast("long")))
    return changed.unionByName(result(docs.filter(~hint), body, F.lit(0).cast("long")))
