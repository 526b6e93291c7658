"""Spelling variants, the filter audit and token counts against brute force, the library, and on odd tables."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import op11_spelling as op11
from lacuna.llm import op12_filter_audit as op12
from lacuna.llm import op13_tokens as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, part string, digest string, mask int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 1, "w", 2, "p", "d", 3, "k") for i, t, lang in rows], DOCS)


def marks(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, part string, A boolean")


ODD = [(1, None, "en"), (2, "", None), (None, "Colour " * 300, "en"), (None, None, None), (3, " \n\t ", ""), (4, "Ünïcödé " * 4000, "fr"), (4, "Ünïcödé " * 4000, "fr"), (5, "x" * 50_000, "en"), (6, "Colour " * 300, "de"), (7, "a # b", "de")]


# -- spelling -------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(rows):
    lower = str.maketrans(op11.UPPER, op11.LOWER)
    n = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    form, near = {}, {}
    for w in n:
        around = [v for v in n if one_edit(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        near[w], form[w] = len(around), best if best and n[best] >= 5 * n[w] else None

    def last(w):
        return last(form[w]) if form[w] else w

    return {(w, form[w], last(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("seed", range(3))
def test_spelling_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randrange(5, 9))) for _ in range(12)]

    def typo(w):
        at, c = rng.randrange(len(w)), rng.choice("abé")
        return rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])

    words = base + [typo(w) for w in base * 3]
    words += [typo(w) for w in words]
    rows = [(i, " ".join(rng.choices(words, [6.0 ** -(j // 12) for j in range(len(words))], k=700)).upper() if i % 2 else "-".join(rng.choices(words, k=200)), "en") for i in range(40)] + ODD
    # A chain of five forms.
    chain = ["qrstuv", "qrstux", "qrstwx", "qrsywx", "qrzywx"]
    rows.append((99, " ".join(w for j, w in enumerate(chain) for _ in range(5 ** (5 - j))), "en"))
    got = op11.spelling_variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = spelling_brute(rows)
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert ("qrzywx", "qrsywx", "qrstuv", 5, 1, 25) in expected


def test_spelling_look_alike_words(spark):
    """Words that share a half and most letters: every near pair once, nothing else."""
    words = [f"common{a}{b}{c}" for a, b, c in itertools.product("abcdefgh", repeat=3)]
    pairs = op11.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).select("a", "b").collect()
    expected = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(pairs) == len(expected) and {tuple(r) for r in pairs} == expected


def test_spelling_lengths_meet(spark):
    words = ["abcdef", "abcdefg", "xabcdef", "abcxdef", "abcdeg", "bcdefgh", "ÿbcdef", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    got = {tuple(r) for r in op11.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).select("a", "b").collect()}
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_spelling_without_words(spark):
    assert op11.spelling_variants(table(spark, [(1, None, None), (2, "ab cd", "en")])).count() == 0


# -- filter audit ---------------------------------------------------------------


def audit_brute(docs, labels):
    good, toxic = ({d for d, *f in labels if d is not None and f[i] == 1} for i in (0, 1))
    flags = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in docs if (u or "") == t and j is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(same) < i}
        flags.append((lang or "", fails, i in good, i in toxic))
    out, shapley = [], collections.Counter()
    for part in {p for p, *_ in flags}:
        mine = [f for f in flags if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                alive = [f for f in mine if not any(f[1][y] for y in order[:k])]
                gone = [f for f in alive if f[1][x]]
                shapley[part, x] += len(gone)
                fail = sum(f[1][x] for f in mine)
                out.append((part, "".join(order), k + 1, len(alive) - len(gone), len(gone), fail - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([20, 150, 230, 300]))) for _ in range(25)] + ["Upper CASE " * 20, "same " * 250, "with # sign " * 10, "one\x1ctwo", "café x \x0b y", None, ""]
    texts += [" ".join(words[:250]) + s for s in (" #", "", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 5)]
    docs = [(rng.randrange(60) if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [*range(50), *range(10), None, None]]
    return docs, labels


def test_audit_equals_brute_force_and_sql(spark):
    docs, labels = audit_rows()
    got = op12.filter_audit(table(spark, docs), marks(spark, [(*x, "p", True) for x in labels])).select(*COLUMNS).collect()
    expected = audit_brute(docs, labels)
    assert len(got) == len(expected) == 600 * len({p or "" for _, _, p in docs}) and {tuple(r) for r in got} == expected
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert set(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({op12.SQL})").fetchall()) == expected


def test_audit_odd(spark):
    got = op12.filter_audit(table(spark, ODD), marks(spark)).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == audit_brute(ODD, [])
    assert op12.filter_audit(table(spark, ODD).limit(0), marks(spark)).count() == 0
    # Last steps: no difference by order, and everything fails something or is kept.
    kept = collections.defaultdict(set)
    for r in got:
        if r["step"] == 5:
            kept[r["part"]].add(r["kept"])
    assert all(len(x) == 1 for x in kept.values())


# -- token counts ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(op13.default_tokenizer())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_library(library):
    rng = random.Random(1)
    letters = [*"aab  \n\t\r'sdtre1!é漢  　\x1c\x85\U0001f600", "<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)]
    texts += ["a" * 20_000, "ab" * 10_000, " " * 10_000, "\n" * 999 + "x", "=-" * 5_000, "", "<|endoftext|>" * 3, "  <|endoftext|>  x"]
    bpe = op13.merges_of(op13.default_tokenizer())
    assert [bpe.tokens(t) for t in texts] == lengths(library, texts)


def test_every_character_counts_as_in_the_library(library):
    bpe = op13.merges_of(op13.default_tokenizer())
    texts = [f"1{chr(c)} {chr(c)}'s a{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert [bpe.tokens(t) for t in texts] == lengths(library, texts)


def test_memory_of_units_is_bounded(monkeypatch):
    monkeypatch.setattr(op13, "REMEMBERED", 10)
    seen = op13.Remembered(len)
    assert [seen["x" * i] for i in range(60)] == list(range(60)) and len(seen) <= 10 and max(map(len, seen)) <= op13.LONGEST


def test_tokens_odd(spark, library):
    docs = table(spark, ODD)
    got = sorted(map(tuple, op13.count_tokens(docs).collect()), key=repr)
    n = lengths(library, [t or "" for _, t, _ in ODD])
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t, _), k in zip(ODD, n)), key=repr)
    assert op13.count_tokens(docs.limit(0)).count() == 0
    assert op13.count_tokens(docs, limit=0).where("over_limit").count() == sum(k > 0 for k in n)
    assert op13.count_tokens(docs.withColumn("doc_id", F.col("doc_id").cast(T.StringType()))).schema["doc_id"].dataType == T.StringType()
