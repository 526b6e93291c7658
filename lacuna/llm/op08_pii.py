"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated items are replaced inside the text by a keyed permutation of their
format, so equal values get equal pseudonyms in every document and nothing else
changes:

* payment cards: 13 to 19 digits that pass the Luhn check; the digits but the
  last are permuted, the check digit is computed anew.  In a run of digits with
  single blanks or hyphens the whole run is tried
  first, then the stretches between blanks or hyphens, of 16 digits,
  15, and then the longest ones; what no card takes is searched for other items.
  A stretch's groups, but the last, have three digits or more, so that lists of
  small numbers are not read as cards;
* telephone numbers with an international or area prefix: the last seven digits
  are permuted together with the area code, the country code stays;
* social security numbers (area not 000, 666 or 900 up; group and serial not zero);
* IPv4 addresses: the 32-bit value is permuted and written as an address;
* calendar dates (year-month-day and day.month.year or day/month/year, 1900 to
  2099): the day number is permuted within the range and written in the form found;
* e-mail addresses: letters and digits of the local part are permuted in place,
  letters as letters and digits as digits;
* access keys (AKIA...) and values of password=, token=, secret= or api_key=:
  the characters after the prefix likewise.

A permutation is a balanced Feistel network of eight rounds on the value's two
halves, its round function a keyed SHA-256; where the network's domain is larger
than the format's, the value walks the cycle until it lies inside.  It can be
undone with the key.  Keys are a parameter; the default is for tests only.

Defined cases: a null text stays null and has no item; an empty one likewise.
Rows with equal doc_id are treated each.  Extra columns are kept.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: For tests; a deployment passes its own.
TEST_KEY = "an example key, not a secret"
ROUNDS = 8

#: Patterns of the items, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": r"(?<![A-Za-z])(?:password|passwd|secret|token|api_key|apikey)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_~-]{8,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "iso_date": r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "day_date": r"(?<![\d./])(?:0[1-9]|[12]\d|3[01])([./])(?:0[1-9]|1[0-2])\1(?:19|20)\d\d(?![\d/]|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<=\+\d{1,3}[ .-])\d{3}[ .-]|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,}+",
}
#: All items; the back reference of day_date is the only group.
ANY = "|".join(PATTERNS.values())
#: What a run of digits may hold beside cards.
IN_RUN = "|".join(PATTERNS[k] for k in ("iso_date", "ssn", "phone"))

FIRST_DAY, DAYS = "1900-01-01", 73049


def _number(tag: Column, value: Column, radix: Column) -> Column:
    """A keyed round value below ``radix``."""
    digest = F.sha2(F.concat_ws("|", tag, value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), radix)


def feistel(key: str, kind: Column, high: Column, low: Column, a: Column, b: Column) -> Column:
    """Permutes (high, low), numbers below ``a`` and ``b``; the result's fields are again below ``a`` and ``b``.

    The halves take turns: the older one gets the keyed value of the newer one
    added modulo its own radix.  Each round can be undone, so the whole can.
    """
    start = F.struct(high.cast("long").alias("x"), low.cast("long").alias("y"))

    def turn(s: Column, i: Column) -> Column:
        radix = F.when(i % 2 == 0, a).otherwise(b).cast("long")
        moved = F.pmod(s["x"] + _number(F.concat_ws("|", F.lit(key), kind, i.cast("string")), s["y"], radix), radix)
        return F.struct(s["y"].alias("x"), moved.alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def walked(key: str, kind: str, x: Column, size: int, most: int = 64) -> Column:
    """Permutes numbers below ``size``: a network on the next square, walked on while outside.

    The square has at most 1 part in 100 outside for the sizes used here, so 64
    steps end inside but for a chance of 1e-128; the value then stays as it is.
    """
    side = int(size**0.5) + 1
    r = F.lit(side)

    def step(s: Column, _: Column) -> Column:
        y = feistel(key, F.lit(kind), F.floor(s / r), s % r, r, r)
        return F.when((s < 0) | (s >= size), F.aggregate(F.array(y), F.lit(-1).cast("long"), lambda _, v: v["x"] * r + v["y"])).otherwise(s)

    once = F.aggregate(F.array(feistel(key, F.lit(kind), F.floor(x / r), x % r, r, r)), F.lit(0).cast("long"), lambda _, v: v["x"] * r + v["y"])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), once, step)
    return F.when(end < size, end).otherwise(x)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def with_digits(form: Column, new: Column) -> Column:
    """``form`` with its digits replaced in order by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(new, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def permuted_digits(key: str, kind: str, d: Column) -> Column:
    """A permutation of the digit strings of the length of ``d`` (2 to 19)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), n - u).cast("long")
    out = feistel(key, F.concat_ws("|", F.lit(kind), n.cast("string")), F.substring(d, F.lit(1), u), F.substring(d, u + 1, n - u), a, b)
    return F.aggregate(F.array(out), F.lit(""), lambda _, s: F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), n - u, "0")))


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of digits whose last one is the check digit's place."""
    places = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def cards(run: Column) -> Column:
    """(from, to) of the cards in a run of digits, as places from 1 of its first and last character, in order.

    Of valid stretches that overlap the whole run wins, then 16 digits, 15, the
    longest, and the first.
    """
    none = F.array().cast("array<struct<from:int,to:int>>")

    def chosen(groups: Column) -> Column:
        n = F.size(groups)
        number = lambda w: F.array_join(F.slice(groups, w["i"], w["j"] - w["i"] + 1), "")
        formed = lambda w: F.forall(F.slice(groups, w["i"], w["j"] - w["i"]), lambda g: F.length(g) >= 3)
        whole = lambda w: (w["i"] == 1) & (w["j"] == n)
        # As a start of the run any grouping is tried, if no longer start has up to 19 digits.
        start = lambda w: (w["i"] == 1) & (F.length(number(w)) + F.coalesce(F.length(F.get(groups, w["j"])), F.lit(19)) > 19)

        def placed(w: Column) -> Column:
            size = F.length(number(w))
            rank = F.when(whole(w), 0).when(~formed(w), 30).when(size == 16, 1).when(size == 15, 2).otherwise(22 - size)
            before = F.aggregate(F.slice(groups, F.lit(1), w["i"] - 1), F.lit(1), lambda s, g: s + F.length(g) + 1)
            return F.struct(rank.alias("rank"), before.alias("from"), (before + size + w["j"] - w["i"] - 1).alias("to"))

        windows = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, F.least(i + 18, n)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        valid = F.filter(windows, lambda w: F.length(number(w)).between(13, 19) & (formed(w) | start(w)) & (luhn_sum(number(w)) % 10 == 0))
        span = lambda c: F.struct(c["from"].alias("from"), c["to"].alias("to"))
        free = lambda taken, c: ~F.exists(taken, lambda t: (t["from"] <= c["to"]) & (c["from"] <= t["to"]))
        return F.aggregate(F.array_sort(F.transform(valid, placed)), none, lambda taken, c: F.when(free(taken, c), F.concat(taken, F.array(span(c)))).otherwise(taken))

    # The aggregate keeps the groups from being split again for every window.
    return F.array_sort(F.aggregate(F.array(F.split(run, "[ -]")), none, lambda _, groups: chosen(groups)))


def _part(text: Column, item: Column | bool) -> Column:
    return F.struct(text.alias("text"), (F.lit(item) if isinstance(item, bool) else item).alias("item"))


def _parts(between: Column, found: Column) -> Column:
    """(text, item) parts of a text from what lies between its items and the items."""
    return F.concat(F.array(_part(F.element_at(between, 1), False)), F.flatten(F.zip_with(found, F.slice(between, F.lit(2), F.size(found)), lambda m, b: F.array(_part(m, True), _part(b, False)))))


def run_parts(run: Column) -> Column:
    """(text, item) parts of a run of digits: its cards, and other items in what is left."""
    rest = lambda t: _parts(F.split(t, IN_RUN, -1), F.regexp_extract_all(t, F.lit(IN_RUN), F.lit(0)))
    start = F.struct(F.array().cast("array<struct<text:string,item:boolean>>").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        before, card = F.substring(run, s["at"], c["from"] - s["at"]), F.substring(run, c["from"], c["to"] - c["from"] + 1)
        return F.struct(F.concat(s["out"], rest(before), F.array(_part(card, True))).alias("out"), (c["to"] + 1).alias("at"))

    return F.aggregate(cards(run), start, put, lambda s: F.concat(s["out"], rest(F.substring(run, s["at"], F.length(run)))))


def permuted_characters(key: str, kind: str, s: Column) -> Column:
    """A permutation of strings that keeps each character's class: digits, small and capital letters move within theirs.

    The two halves take turns as in ``feistel``, character by character.
    """
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), u).alias("x"), F.substring(s, u + 1, n - u).alias("y"))

    def moved(c: Column, k: Column) -> Column:
        def within(first: str, size: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - ord(first) + k, F.lit(size)) + ord(first))

        return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)

    def turn(t: Column, i: Column) -> Column:
        tag = lambda p: F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), p.cast("string"))
        chars = F.transform(F.split(t["x"], ""), lambda c, p: F.when(c == "", "").otherwise(moved(c, _number(tag(p), t["y"], F.lit(1 << 40)))))
        return F.struct(t["y"].alias("x"), F.array_join(chars, "").alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda t: F.concat(t["x"], t["y"]))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a matched item; a match that fails its validation comes back as it is."""
    is_a = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    d = digits(m)
    local, domain = F.regexp_extract(m, r"^([^@]*)@", 1), F.regexp_extract(m, r"(@.*)$", 1)
    named, value = F.regexp_extract(m, r"^([A-Za-z_]+[\"']? ?[=:] ?[\"']?)", 1), F.regexp_extract(m, r"^[A-Za-z_]+[\"']? ?[=:] ?[\"']?(.*)$", 1)
    parts = F.split(m, r"\.")
    part = lambda i: F.element_at(parts, i).cast("long")
    square = F.lit(65536)
    ip = feistel(key, F.lit("ip"), part(1) * 256 + part(2), part(3) * 256 + part(4), square, square)
    address = F.aggregate(F.array(ip), F.lit(""), lambda _, s: F.concat_ws(".", *[(F.floor(s[x] / k) % 256).cast("string") for x, k in (("x", 256), ("x", 1), ("y", 256), ("y", 1))]))

    def day(text: Column, form: str) -> Column:
        number = F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        return F.when(number.isNotNull(), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walked(key, "date", number, DAYS).cast("int")), form)).otherwise(text)

    slashed = F.translate(m, ".", "/")
    new_day = F.when(m.contains("."), F.translate(day(slashed, "dd/MM/yyyy"), "/", ".")).otherwise(day(m, "dd/MM/yyyy"))
    area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
    area_index = area - 1 - F.when(area > 666, 1).otherwise(0)
    ssn = walked(key, "ssn", (area_index * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)

    def ssn_digits(v: Column) -> Column:
        a = F.floor(v / (99 * 9999))
        a = a + 1 + F.when(a >= 665, 1).otherwise(0)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(v / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))

    ssn_text = with_digits(m, F.aggregate(F.array(ssn), F.lit(""), lambda _, v: ssn_digits(v)))
    code = F.length(d) - 10
    phone = F.concat(F.substring(d, F.lit(1), code), permuted_digits(key, "phone", F.substring(d, code + 1, F.lit(10))))
    body = permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
    card = F.aggregate(F.array(body), F.lit(""), lambda _, p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return (
        F.when(m.contains("@"), F.concat(permuted_characters(key, "email", local), domain))
        .when(is_a("key"), F.concat(F.lit("AKIA"), permuted_characters(key, "key", F.substring(m, 5, 16))))
        .when(m.rlike(r"^[A-Za-z]"), F.concat(named, permuted_characters(key, "secret", value)))
        .when(is_a("ip"), address)
        .when(is_a("iso_date"), day(m, "yyyy-MM-dd"))
        .when(is_a("day_date"), new_day)
        .when(is_a("ssn"), ssn_text)
        .when(m.rlike(r"^(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), with_digits(m, phone))
        .when(luhn_sum(d) % 10 == 0, with_digits(m, card))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str = TEST_KEY) -> DataFrame:
    """``docs`` with the items in ``text`` replaced; n_items counts those that changed."""
    text = F.col("text")
    # Inner columns take names that the input does not have.
    taken = max(map(len, docs.columns))
    found, cut, made = (name.ljust(taken + 1, "_") for name in ("_p", "_parts", "_new"))
    pieces = F.when(text.rlike(ANY), F.struct(F.split(text, ANY, -1).alias("between"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found")))
    is_run = lambda p: p["item"] & p["text"].rlike(f"^(?:{PATTERNS['card']})$") & ~p["text"].rlike(f"^(?:{IN_RUN})$")
    parts = F.flatten(F.transform(_parts(F.col(found)["between"], F.col(found)["found"]), lambda p: F.when(is_run(p), run_parts(p["text"])).otherwise(F.array(p))))
    # The generators keep what they make from being computed again wherever it is read.
    a = docs.select("*", F.inline(F.array(F.struct(pieces.alias(found)))))
    a = a.select("*", F.inline(F.array(F.struct(F.when(F.col(found).isNotNull(), parts).alias(cut)))))
    new = F.transform(cut, lambda p: F.when(p["item"], pseudonym(key, p["text"])).otherwise(p["text"]))
    b = a.select("*", F.inline(F.array(F.struct(new.alias(made)))))
    changed = F.size(F.filter(F.zip_with(cut, made, lambda p, new: p["text"] != new), lambda c: c))
    out = F.when(F.col(found).isNull(), text).otherwise(F.array_join(made, ""))
    kept = [out.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_items"]
    return b.select(*kept, F.when(F.col(found).isNull(), 0).otherwise(changed).cast("long").alias("n_items"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
