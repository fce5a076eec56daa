"""Surrogates for personal data: keyed replacements of the same kind, gender, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import let
from memlake.llm.base import narrow, no_items
from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

SECRET = "surrogates"
MAX_ROUNDS = 64

# What personal data looks like.
EMAIL = r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
LABEL = r"""(?i:password|passwd|pwd|token|secret|api[_-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""
LABELLED = LABEL + r"""(?=[^\s"',;]{0,60}[0-9])[^\s"',;]{6,}"""
KEY_PREFIX = r"AKIA|gh[pousr]_|sk-|AIza|xox[abprs]-"
ACCESS_KEY = rf"(?:{KEY_PREFIX})[A-Za-z0-9_-]{{16,}}+"
HEX = r"[0-9a-f]{32,64}+(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"{OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
)
NUMBER = r"[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Señor", "Monsieur"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme"],
    "x": ["Dr", "Prof"],
}
# Names by gender and script.
GIVEN = {
    ("m", "latin"): ["James", "Robert", "Michael", "William", "Thomas", "Daniel", "Matthew", "Anthony", "Steven",
                     "Joshua", "Kenneth", "Kevin", "Edward", "Jürgen", "Stefan", "Wolfgang", "Pierre", "François",
                     "Carlos", "Miguel"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Margaret",
                     "Sandra", "Ashley", "Kimberly", "Emily", "Sabine", "Monika", "Ursula", "Sylvie", "Chantal",
                     "Lucía", "Carmen"],
    ("m", "cyrillic"): ["Александр", "Дмитрий", "Сергей", "Андрей", "Алексей", "Иван", "Михаил", "Николай"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
}
#: Given names that are found besides those above; surrogates are not drawn from them. Names that are mostly words
#: of the language (Will, May, April, Hope, Art) or places (Austin, Paris, Virginia) are left out.
FOUND = {
    "m": """John David Richard Joseph Charles Christopher Mark Donald Paul Andrew George Brian Timothy Ronald Jason Jeffrey
        Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Scott Brandon Benjamin Samuel Gregory Alexander Patrick
        Raymond Dennis Jerry Tyler Aaron Henry Douglas Peter Adam Nathan Zachary Walter Kyle Harold Carl Jeremy Keith
        Roger Gerald Ethan Arthur Terry Lawrence Sean Christian Albert Joe Austen Jesse Bryan Billy Bruce Ralph Roy
        Louis Eugene Philip Bobby Johnny Simon Oliver Harry Jack Luke Martin Adrian Victor Oscar Felix Leon Hugo Max
        Tom Tim Bob Mike Dave Steve Jim Dan Ben Sam Alex Nick Chris Matt Tony Fred Alan Ian Neil Graham Colin Howard
        Hans Klaus Karl Heinrich Friedrich Günter Günther Dieter Helmut Manfred Uwe Bernd Rainer Andreas Matthias
        Tobias Sebastian Florian Jörg Jens Lars Sven Lukas Jonas Jean Jacques Michel Philippe Alain Bernard Luc
        Nicolas Laurent Olivier Julien Antoine Marc René Étienne Gérard Guillaume Henri José Juan Luis Antonio
        Francisco Manuel Javier Pedro Jorge Alejandro Fernando Rafael Diego Pablo Sergio Andrés Ángel Ramón Enrique
        Roberto Ricardo Eduardo Mario Marco Giovanni Giuseppe Paolo Luca Ahmed Mohammed Muhammad Mohamed Ali Omar
        Hassan Ibrahim Yusuf Raj Ravi Amit Sanjay Vijay Rahul Wei Hiroshi Kenji Takashi Ivan Igor Dmitri Sergei
        Владимир Юрий Павел Виктор Олег Игорь Константин Роман Василий Пётр Борис Григорий Максим Антон Евгений
        Никита Илья Кирилл Артём""".split(),
    "f": """Sarah Karen Lisa Nancy Betty Donna Carol Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia
        Dorothy Amy Kathleen Angela Shirley Brenda Emma Anna Pamela Nicole Samantha Katherine Catherine Christine
        Helen Debra Rachel Carolyn Janet Maria Heather Diane Olivia Julie Joyce Victoria Ruth Lauren Kelly Christina
        Joan Evelyn Judith Andrea Hannah Megan Cheryl Jacqueline Martha Teresa Sara Ann Anne Kathryn Gloria Alice
        Jean Abigail Sophia Sophie Frances Julia Judy Isabella Theresa Diana Natalie Brittany Marie Kayla Alexis Lori
        Jane Kate Lucy Ella Claire Charlotte Eleanor Fiona Gillian Hazel Irene Joanna Nina Paula Rosemary Sheila Tina
        Vanessa Wendy Yvonne Anja Birgit Brigitte Christa Claudia Gabriele Gisela Heike Helga Ingrid Jutta Karin Katrin
        Kerstin Petra Renate Silke Stefanie Susanne Ulrike Ute Greta Anke Isabelle Nathalie Françoise Catherine
        Martine Monique Jacqueline Valérie Véronique Céline Hélène Élodie Aurélie Camille Juliette Ana Isabel Rosa
        Pilar Dolores Teresa Cristina Marta Elena Beatriz Raquel Silvia Mónica Inés María Giulia Francesca Chiara
        Fatima Aisha Leila Priya Anita Sunita Mei Yuki Natasha Svetlana Olga Irina
        Екатерина Анастасия Юлия Людмила Галина Вера Надежда Валентина Дарья Ксения Полина Виктория Марина Софья
        Любовь Александра Евгения""".split(),
}
SURNAMES = {
    "latin": ["Abbott", "Barnett", "Caldwell", "Donovan", "Ellsworth", "Fairchild", "Garrison", "Holloway",
              "Ingram", "Jennings", "Kendall", "Lockwood", "Merritt", "Norwood", "Osborne", "Prescott", "Quimby",
              "Radcliffe", "Sheridan", "Thornton", "Underhill", "Vaughan", "Whitaker", "Yardley"],
    "cyrillic": ["Белов", "Волков", "Громов", "Егоров", "Жуков", "Зайцев", "Киселёв", "Лебедев", "Морозов",
                 "Новиков", "Орлов", "Соколов"],
}
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for some in TITLES.values() for t in some)


def _given(gender: str) -> list[str]:
    """All given names of one gender that are found. A name of both lists is of none."""
    of = {g: [n for (x, _), some in GIVEN.items() if x == g for n in some] + FOUND[g] for g in FOUND}
    other = {n for g, some in of.items() if g != gender for n in some}
    return sorted(set(of[gender]) - other)


def _any_of(names: list[str]) -> str:
    """A pattern for listed names, by their first letters, longer ones first."""
    heads = sorted({n[0] for n in names})
    return "|".join(h + "(?:" + "|".join(sorted((n[1:] for n in set(names) if n[0] == h), key=len, reverse=True)) + ")"
                    for h in heads)


_FIRST = _any_of([n for some in GIVEN.values() for n in some] + FOUND["m"] + FOUND["f"])
TITLED = rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}"
NAMED = rf"(?:{_FIRST})(?: {_NAME}){{1,2}}"
#: Everything starts where a word starts, or at a sign that opens a telephone number.
MENTION = (
    r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}+(])(?:"
    + "|".join([LABELLED, EMAIL, ACCESS_KEY, IBAN, HEX, IP, SSN, PHONE, NUMBER, TITLED, NAMED])
    + ")"
)

_DIGITS = ("phone", "number", "ssn")
_NAMES = ("given_m", "given_f", "given_x", "surname")
_SEGMENT = "struct<kind:string,value:string>"


def _segment(kind: Column | None, value: Column) -> Column:
    kind = F.lit(None).cast("string") if kind is None else kind
    return F.struct(kind.alias("kind"), value.alias("value"))


def _name_segments(mention: Column) -> Column:
    """Titles and blanks stay; the last word is the surname, those before are given names of one gender."""
    def build(words):
        first = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
        titled = first.isin(*[t for some in TITLES.values() for t in some])
        man = first.isin(*TITLES["m"], *_given("m"))
        woman = first.isin(*TITLES["f"], *_given("f"))
        given = F.when(man, "given_m").when(woman, "given_f").otherwise("given_x")
        # An 's after a name is no part of it, or the name would be another in the genitive.
        core = lambda w: F.regexp_replace(w, "['’]s$", "")
        return F.flatten(F.transform(words, lambda w, i: F.array(
            _segment(None, F.when(i > 0, " ").otherwise("")),
            _segment(F.when(titled & (i == 0), F.lit(None).cast("string"))
                     .when(i == F.size(words) - 1, "surname").otherwise(given), core(w)),
            _segment(None, F.substring(w, F.char_length(core(w)) + 1, F.char_length(w))),
        )))

    return let(F.split(mention, " "), build)


def segments(mention: Column) -> Column:
    """A mention as pieces: those with a kind are replaced, the others stay."""
    value = F.regexp_replace(mention, f"^{LABEL}", "")
    label = F.substring(mention, F.lit(1), F.char_length(mention) - F.char_length(value))
    whole = lambda kind: F.array(_segment(F.lit(kind), mention))
    return (
        F.when(mention.rlike(f"^(?:{LABELLED})$"), F.array(_segment(None, label), _segment(F.lit("secret"), value)))
        .when(F.contains(mention, F.lit("@")), whole("email"))
        .when(mention.rlike(f"^(?:{ACCESS_KEY}|{HEX})$"), whole("secret"))
        .when(mention.rlike(f"^(?:{IBAN})$"), whole("iban"))
        .when(mention.rlike(f"^(?:{IP})$"), whole("ip"))
        .when(mention.rlike(f"^(?:{SSN})$"), whole("ssn"))
        .when(mention.rlike(f"^(?:{PHONE})$"), whole("phone"))
        .when(mention.rlike(r"^[0-9]"), whole("number"))
        .otherwise(_name_segments(mention))
    )


def normal_form(kind: Column, value: Column) -> Column:
    """What two mentions of one entity have in common."""
    return (
        F.when(kind.isin(*_DIGITS), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind.isin("email", *_NAMES), F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def _byte(digest: Column, i: Column) -> Column:
    """A number from 0 to 255 out of the digest's hex digits, the stream starting over after 31."""
    return F.conv(F.substring(digest, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 31).cast("int") * 7


def _scramble(value: Column, digest: Column, kept: Column) -> Column:
    """Every letter and digit after the first ``kept`` moves inside its class, by the digest."""
    hexed = value.rlike("^[0-9a-f]*$") & value.rlike("[0-9]")

    def moved(c, i):
        n = _byte(digest, i) + F.ascii(c)
        return (
            F.when((i < kept) | ~c.rlike("^[0-9A-Za-z]$"), c)
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
            .when(hexed, F.char(n % 6 + 97))
            .otherwise(F.char(n % 26 + 97))
        )

    return F.array_join(F.transform(F.split(value, ""), moved), "")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a number whose last digit is the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (
        F.when(i % 2 == 0, c.cast("int"))
        .otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _number(value: Column, digest: Column) -> Column:
    """Keeps the first digit and, where the number has a check digit, makes the new one right."""
    def checked(new):
        body = F.concat(F.substring(new, F.lit(1), F.char_length(new) - 1), F.lit("0"))
        check = F.substring(body, F.lit(1), F.char_length(new) - 1)
        right = F.concat(check, ((F.lit(10) - _luhn_sum(body) % 10) % 10).cast("string"))
        return F.when(_luhn_sum(value) % 10 == 0, right).otherwise(new)

    return let(_scramble(value, digest, F.lit(1)), checked)


def _ip(value: Column, digest: Column) -> Column:
    def octet(part, i):
        n = _byte(digest, i * 3) * 256 + _byte(digest, i * 3 + 1)
        size = F.char_length(part)
        return (F.when(size == 1, n % 9 + 1).when(size == 2, n % 90 + 10).otherwise(n % 156 + 100)).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _email(value: Column, digest: Column, secret: str) -> Column:
    """Addresses of one domain stay in one domain; its last part stays as it is."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(last) - 1)
    plain = F.regexp_replace(local, r"[^\x00-\x7F]", "x")
    return F.concat(
        _scramble(plain, digest, F.lit(0)), F.lit("@"),
        let(F.sha2(F.concat(F.lit(f"{secret}|domain|"), domain), 256), lambda d: _scramble(host, d, F.lit(0))),
        F.lit("."), last,
    )


def _listed(kind: Column, value: Column, digest: Column, nonce: Column) -> Column:
    """A listed name of the gender and script; every further try joins one more."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    names = lambda some: F.array(*[F.lit(n.lower()) for n in some])
    both = lambda script: GIVEN["m", script] + GIVEN["f", script]
    options = F.when(cyrillic, F.when(kind == "given_m", names(GIVEN["m", "cyrillic"]))
                     .when(kind == "given_f", names(GIVEN["f", "cyrillic"]))
                     .when(kind == "given_x", names(both("cyrillic"))).otherwise(names(SURNAMES["cyrillic"]))
                     ).otherwise(F.when(kind == "given_m", names(GIVEN["m", "latin"]))
                                 .when(kind == "given_f", names(GIVEN["f", "latin"]))
                                 .when(kind == "given_x", names(both("latin"))).otherwise(names(SURNAMES["latin"])))

    def pick(some):
        return F.array_join(F.transform(
            F.sequence(F.lit(0), nonce),
            lambda j: F.get(some, (_byte(digest, j * 2) * 256 + _byte(digest, j * 2 + 1)) % F.size(some))), "-")

    return let(options, pick)


def surrogate(kind: Column, normal: Column, nonce: Column, secret: str = SECRET) -> Column:
    """The keyed replacement of an entity in normal form. ``nonce`` counts the tries before."""
    digest = F.sha2(F.concat_ws("|", F.lit(secret), kind, nonce.cast("string"), normal), 256)
    prefix = F.char_length(F.regexp_extract(normal, f"^(?:{KEY_PREFIX})", 0))
    country = F.greatest(F.char_length(normal) - 10, F.lit(0))
    return let(digest, lambda d: (
        F.when(kind == "email", _email(normal, d, secret))
        .when(kind == "ip", _ip(normal, d))
        .when(kind == "number", _number(normal, d))
        .when(kind == "phone", _scramble(normal, d, country))
        .when(kind == "iban", _scramble(normal, d, F.lit(2)))
        .when(kind.isin(*_NAMES), _listed(kind, normal, d, nonce))
        .otherwise(_scramble(normal, d, F.when(kind == "secret", prefix).otherwise(0)))
    ))


def dress(kind: Column, value: Column, new: Column) -> Column:
    """The replacement in the format of the mention: its separators, and its case."""
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike("[0-9]"),
        F.substring(new, F.char_length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1)),
    ).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c != " ",
        F.substring(new, F.char_length(F.replace(F.substring(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)),
    ).otherwise(c)), "")
    titled = F.array_join(F.transform(F.split(new, "-"), lambda p: F.initcap(p)), "-")
    upper = (value == F.upper(value)) & (value != F.lower(value))
    return (
        F.when(kind.isin(*_DIGITS), filled)
        .when(kind == "iban", spaced)
        .when(kind.isin("email", *_NAMES) & upper, F.upper(new))
        .when(kind.isin(*_NAMES), titled)
        .otherwise(new)
    )


def mentions(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), no_items("string"))


def repeats_of(names: Column) -> Column:
    """A pattern for bare repeats of names in normal form: whole words that begin with a capital."""
    longest_first = F.sort_array(F.transform(names, lambda n: n["normal"]), asc=False)
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(longest_first, "|"),
                    F.lit(r")(?![\p{L}\p{N}])"))


def entities(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct entities of every document: doc_id, print (of its text), kind, normal."""
    rows = narrow(docs, doc_id=id, _text=text)
    found = rows.select(
        "doc_id", F.xxhash64("_text").alias("print"),
        F.explode(F.flatten(F.transform(mentions(F.col("_text")), segments))).alias("_s"),
    )
    kind, value = F.col("_s")["kind"], F.col("_s")["value"]
    return found.where(kind.isNotNull()).select(
        "doc_id", "print", kind.alias("kind"), normal_form(kind, value).alias("normal")
    ).distinct()


def settle(atoms: DataFrame, secret: str = SECRET) -> DataFrame:
    """A distinct surrogate for every entity: kind, normal, nonce, new.

    ``atoms``: distinct (kind, normal). All entities start at their first try. If several meet at one
    replacement, the one with the fewest tries, then the first in order, keeps it and the others try again,
    until none meet. Nobody keeps a replacement that is a true entity of the corpus (for names: their own
    name, as the lists hold common ones).
    """
    state = atoms.select("kind", "normal", F.lit(0).alias("nonce"))
    for _ in range(MAX_ROUNDS):
        state = cut_lineage(state.select(
            "kind", "normal", "nonce", surrogate(F.col("kind"), F.col("normal"), F.col("nonce"), secret).alias("new")
        ))
        winners = state.groupBy("kind", "new").agg(F.min(F.struct("nonce", "normal")).alias("_w"))
        winners = winners.where(~F.col("kind").isin(*_NAMES) | (F.col("new") != F.col("_w")["normal"]))
        real = atoms.where(~F.col("kind").isin(*_NAMES)).select("kind", F.col("normal").alias("new"))
        kept = winners.join(real, ["kind", "new"], "left_anti").select(
            "kind", F.col("_w")["normal"].alias("normal"), F.lit(True).alias("_kept")
        )
        judged = cut_lineage(state.join(kept, ["kind", "normal"], "left"))
        if judged.where(F.col("_kept").isNull()).isEmpty():
            return state
        again = F.when(F.col("_kept"), F.col("nonce")).otherwise(F.col("nonce") + 1)
        state = judged.select("kind", "normal", again.alias("nonce"))
    raise RuntimeError(f"no distinct surrogates after {MAX_ROUNDS} tries")


def replace_entities(docs: DataFrame, id: str = "doc_id", text: str = "text", secret: str = SECRET) -> DataFrame:
    """Every detected entity replaced by its surrogate, the same one in the whole corpus.

    Returns doc_id, text, n_entities (mentions) and kinds (of the entities, sorted), one row per input row.
    A surrogate follows from the key, the kind and the entity's normal form, so mentions of one entity agree
    wherever they are, and mail addresses of one domain share a domain. Names that a title or a listed given
    name tells are then looked for in the rest of the same text, alone, and replaced there too. Only entities whose first try met
    another's are looked up: their documents get the number of tries by a join, all other rows need none.

    Null text: stays null, no entities. Empty and long texts are treated alike; repeated rows each come back;
    a null id is a value. Empty tables give no rows; other columns are ignored.
    """
    occurrences = cut_lineage(entities(docs, id, text))
    settled = settle(cut_lineage(occurrences.select("kind", "normal").distinct()), secret)
    later = settled.where("nonce > 0").select("kind", "normal", "nonce")
    tries = cut_lineage(
        occurrences.join(broadcast_if_small(later), ["kind", "normal"])
        .groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
        .agg(F.map_from_entries(F.collect_set(F.struct(
            F.concat_ws("|", "kind", "normal"), "nonce"))).alias("_tries"))
    )
    rows = narrow(docs, doc_id=id, text=text).join(
        broadcast_if_small(tries),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print")), "left",
    ).select("doc_id", "text", "_tries")
    split = rows.select(
        "doc_id", "text", "_tries", mentions(F.col("text")).alias("_m"), F.split("text", MENTION, -1).alias("_gaps")
    ).withColumn("_parts", F.transform("_m", segments))

    def replaced(part):
        def known(normal):
            tries = F.coalesce(F.element_at(F.col("_tries"), F.concat_ws("|", part["kind"], normal)), F.lit(0))
            return dress(part["kind"], part["value"], surrogate(part["kind"], normal, tries, secret))

        return F.when(part["kind"].isNull(), part["value"]).otherwise(
            let(normal_form(part["kind"], part["value"]), known))

    # Names of the text, a word that is both kinds of name as a surname; what is between the mentions may repeat them.
    pieces = F.filter(F.flatten("_parts"), lambda p: p["kind"].isin(*_NAMES))
    found = F.array_distinct(F.transform(pieces, lambda p: F.struct(
        normal_form(p["kind"], p["value"]).alias("normal"), p["kind"].alias("kind"))))
    split = split.withColumn("_names", F.filter(found, lambda n: n["normal"] != ""))
    split = split.withColumn("_bare", F.when(F.size("_names") > 0, repeats_of(F.col("_names"))))
    split = split.withColumn("_again", F.transform("_gaps", lambda g: F.coalesce(
        F.regexp_extract_all(g, F.col("_bare"), F.lit(0)), no_items("string"))))
    n_again = F.aggregate("_again", F.lit(0), lambda n, some: n + F.size(some))

    def repeated(word):
        kind = F.array_max(F.transform(F.filter("_names", lambda n: n["normal"] == F.lower(word)), lambda n: n["kind"]))
        return let(_segment(kind, word), replaced)

    filled = F.transform("_gaps", lambda g, i: F.when(F.size(F.get("_again", i)) == 0, g).otherwise(
        F.array_join(F.transform(F.split(g, F.col("_bare"), -1), lambda rest, k: F.concat(
            rest, F.coalesce(repeated(F.get(F.get("_again", i), k)), F.lit("")))), "")))
    new = split.withColumn("_n", F.size("_m") + n_again).withColumn("_gaps", filled).withColumn(
        "_new", F.transform("_parts", lambda some: F.array_join(F.transform(some, replaced), "")))
    joined = let(F.col("_new"), lambda some: F.array_join(
        F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.get(some, i), F.lit("")))), ""))
    kinds = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.flatten("_parts"), lambda p: p["kind"]), lambda k: k.isNotNull())))
    return new.select(
        "doc_id", F.when(F.size("_m") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.col("_n").cast("long").alias("n_entities"), kinds.alias("kinds"),
    )
