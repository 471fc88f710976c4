"""Exact dedup, url filter and decontamination: brute force and edge cases."""

import hashlib
import random
import re
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from umbraloom.llm import decontamination as D
from umbraloom.llm import queries
from umbraloom.llm import url_filter as U
from umbraloom.llm.common import Scratch, components
from umbraloom.llm.decontamination import clean_documents, decontaminate
from umbraloom.llm.exact_dedup import exact_dedup, keep_first
from umbraloom.llm.ngram_join import keep_one

DOCS = "doc_id long, text string"
CASES = [(5, "a  b"), (3, "a\tb"), (9, None), (7, ""), (8, "   "), (1, "a b "), (2, " a b"), (4, "a b"), (6, "x" * 200_000), (10, "x" * 200_000), (11, "é\u00a0b"), (12, "é b")]


def extra(spark, rows, schema=DOCS):
    """With columns whose names operators use inside, and repeated partitions."""
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS kept", "'q' AS digest", "2 AS group_size", "null AS norm", "3 AS component", "4 AS n", "5 AS bucket").repartition(3)


@pytest.mark.parametrize("digest_bytes", [32, 8])
@pytest.mark.parametrize("memtable", [2, 1000])
def test_exact(spark, digest_bytes, memtable):
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(extra(spark, CASES), digest_bytes, memtable).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in CASES}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        assert got[i] == (min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest())


def test_exact_verifies_colliding_digests(spark, monkeypatch):
    from umbraloom.llm import exact_dedup as E

    real = E.F.substring
    monkeypatch.setattr(E.F, "substring", lambda c, a, n: E.F.unhex(E.F.lit("00" * 8)) if c == "sha" else real(c, a, n))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2), 5: (5, 1)}


def told(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def test_exact_odd_tables(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "a")]
    assert told(exact_dedup(spark.createDataFrame(rows, DOCS))) == [(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False)]
    assert [r["doc_id"] for r in keep_first(extra(spark, rows)).collect()] == [1]
    rows = [(None, "a"), (None, "a "), (None, "b"), (5, "c"), (5, "d"), (6, "d"), (5, "c")]
    assert told(exact_dedup(spark.createDataFrame(rows, DOCS))) == [(5, 5, 2, True)] * 3 + [(6, 5, 2, False)] + [(None, None, 1, True)] * 3
    assert sorted((r["doc_id"] or 0, r["text"]) for r in keep_first(extra(spark, rows)).collect()) == [(0, "a"), (0, "a "), (0, "b"), (5, "c"), (5, "d")]
    assert keep_first(extra(spark, [])).count() == 0


ODD = [(1, "x y"), (1, "x  y"), (None, "x y"), (2, None), (None, None), (None, ""), (None, ""), (7, "z"), (7, "z"), (7, "w w w w w w"), (3, "w w w w w w"), (None, "only here"), (None, "only here")]


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_ngram_join"])
def test_odd_rows_are_those_of_the_sql(spark, name, tmp_path):
    rows = ODD if name.startswith("op1") else [r for r in ODD if r[0] is not None]  # the SQL of op9 knows no rows without id
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    cur = db.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) and got.count() == len(rows)


def test_stages_keep_columns_of_any_name(spark):
    names = ["_id", "_own", "_word", "_bits", "_bit", "_digest", "_sha", "_mine", "_own_", "_WORD_", "row", "kept"]
    docs = spark.createDataFrame([(k, t, *[f"{k}-{c}" for c in names]) for k, t in [(1, "a b c d e f"), (2, "a b  c d e f"), (3, "q"), (4, None)]], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    for rows in (docs, docs.unionAll(docs)):
        for stage, left in ((keep_first, {1, 3, 4}), (keep_one, {1, 3, 4})):
            got = stage(rows)
            assert got.columns == docs.columns
            assert {r["doc_id"] for r in got.collect()} == left and all(r[c] == f"{r['doc_id']}-{c}" for r in got.collect() for c in names)


def test_exact_hot_digests(spark, monkeypatch):
    from umbraloom.llm import common, exact_dedup as E

    monkeypatch.setattr(E, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = [(i, "same  text" if i % 3 else f"t {i % 7}") for i in range(1, 200)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(extra(spark, rows)).collect()}
    texts = dict(rows)
    assert got == {i: (min(j for j in texts if texts[j] == t), sum(u == t for u in texts.values())) for i, t in rows}


def test_url_rules_and_terms(spark):
    urls = ["http://A.Example.com/en/7?x", "https://x.com/en/", "http://com/en/1", "http://xcom.net/de/1", "http://example.net/de/81", "http://a.org/es/casino", "http://a.org/fr/casino-1", "http://a.org/fr/casinos", "http://a.org/fr/free/win", "http://a.org/free-free", None, "no scheme casino", "", "a://b://c/d#e?f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' AS host", "'z' AS path")
    got = {r["page_id"]: r for r in U.url_filter(df).collect()}
    assert [got[i]["rule"] for i in range(6)] == ["example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", "org/es/"]
    assert [got[i]["verdict"] for i in range(14)] == ["allow", "block", "block", "allow", "block", "block", "block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    assert (got[13]["host"], got[13]["path"]) == ("b:", "//c/d") and (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7") and got[11]["host"] == got[10]["host"] == ""


def test_url_odd_rows_and_tables_of_terms(spark):
    rows = [(None, "http://a.org/casino"), (1, "http://a.org/x" + "y" * 300_000 + "/casino"), (1, "http://a.org/x" + "y" * 300_000 + "/casino"), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS rule", "'z' AS verdict")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in U.url_filter(df).collect()) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")]
    assert U.url_filter(df.limit(0)).count() == 0
    strict, soft = U.vocabulary(spark.createDataFrame([("Bad", 5), ("meh", 1), ("so", 1), ("meh", 1), ("", 9), (None, 2)], "term string, weight int"))
    assert (strict, soft) == (["bad"], {"meh": 1, "so": 1})
    urls = spark.createDataFrame(list(enumerate(["h://a/bad", "h://a/meh", "h://a/meh/so", "h://a/casino"])), "page_id long, url string")
    assert [r["verdict"] for r in U.url_filter(urls, strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError):
        U.vocabulary(spark.createDataFrame([("a", 1), ("b", 1)], "term string, weight int"), most=1)
    weighted = spark.createDataFrame([("three", 3), ("also", 3), ("one", 1), ("uno", 1), ("five", 5)], "term string, weight int")
    strict, soft = U.vocabulary(weighted, soft_limit=5)
    cases = {"h://a/three/also": "block", "h://a/three/three": "allow", "h://a/three/one/uno": "block", "h://a/three/one": "allow", "h://a/five": "block", "h://a/three-also": "block", "h://a/threealso": "allow"}
    got = U.url_filter(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), strict=strict, soft=soft, soft_limit=5).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == list(cases.values()) and [r["weight"] for r in got] == [6, 3, 5, 4, 5, 6, 0]
    with pytest.raises(Exception, match="no whole weight: a"):
        U.vocabulary(spark.createDataFrame([("a", 1.5)], "term string, weight double"))
    same = U.url_filter(urls, rules=(("block", "a/me"), ("allow", "a/me"))).collect()
    assert [r["verdict"] for r in same if r["rule"]] == ["allow", "allow"]


def brute_windows(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        own.add(str(name))
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    long = " ".join(f"w{i}" for i in range(14))
    items = [(10, long), (9, "Short One"), (2, None), (3, "..."), (4, "été; 7x")]
    docs = [(1, "x " + long.upper().replace(" ", ", ") + " y"), (2, "a short\none b"), (3, None), (4, ""), (5, " ".join(long.split()[:9])), (6, "ÉTÉ 7x"), (7, "été-7X!"), (8, "short " * 50_000 + "one"), (9, "shortone")]
    df, bench = extra(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = brute_windows(docs, items)
    for block in (1 << 20, 1):
        got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate(df, bench, block).collect()}
        assert got == want
    spans = {r["doc_id"]: r["spans"] for r in decontaminate(df, bench).collect()}
    assert docs[0][1][spans[1][0]["start"] : spans[1][0]["end"]].startswith("W0, W1")
    assert sorted(r["doc_id"] for r in clean_documents(df, bench).collect()) == [i for i, w in want.items() if not w[4]]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(df, none).where("contaminated").count() == 0 and decontaminate(spark.createDataFrame([], DOCS), bench).count() == 0


def test_decontamination_does_not_depend_on_blocks(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text.upper() + "."), (None, "a b c"), (None, "c b a"), (None, None), (None, ""), (2, "x " + text)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(5 * i, 5 * i + 12))) for i in range(4)] + [(9, "w30 w31 w32 w33 w34 w35 w36 w37 w38 w39")], "item_id long, text string")
    rows = [sorted(map(str, decontaminate(docs, bench, size).collect())) for size in (1, 60, 1 << 20)]
    assert len(rows[0]) == 8 and rows[0] == rows[1] == rows[2]
    spans = decontaminate(docs, bench, 1).where("doc_id = 2").first()["spans"]
    assert [tuple(s) for s in spans] == [(2, 2 + text.index(" w27")), (2 + text.index("w30"), 2 + len(text))]


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Solo"), (3, "duo pair"), (4, None), (1, "again here")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "solo", "a"), (1, "x solo, DUO-pair", "b"), (1, "x solo, DUO-pair", "b"), (2, "duo. solos", "c"), (3, None, "d"), (4, "again here", "e"), (5, "two three four five six seven eight nine ten", "f")], "doc_id long, text string, items string").repartition(2)
    got = sorted((r["doc_id"] or 0, r["n_hit"], ",".join(r["items"])) for r in decontaminate(docs, bench).collect())
    assert got == [(0, 1, "2"), (1, 3, "2,3"), (1, 3, "2,3"), (2, 0, ""), (3, 0, ""), (4, 2, "1"), (5, 0, "")]
    for size in (1, 1 << 20):
        assert sorted(r["items"] for r in clean_documents(docs, bench, size).collect()) == ["c", "d", "f"]


def test_many_items_stay_fast():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30_000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs, took = [text(2000).encode() for _ in range(40)], []
    for n in (200, 20_000):
        m = D.Matcher([(str(i), text(30)) for i in range(n)])
        began = time.process_time()
        list(D.scanned(docs, m))
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abA .é\n", max_size=40), max_size=5), st.lists(st.text("abA .é", max_size=30), max_size=4))
def test_matcher_against_brute_force(texts, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    got = list(D.scanned([t.encode() for t in texts], D.Matcher(named)))
    want = brute_windows(list(enumerate(texts)), named)
    assert [(n, len(h), len(i)) for n, h, i in got] == [want[k][:3] for k in range(len(texts))]
    for (_, hits, _), t in zip(got, texts, strict=True):
        assert all(re.fullmatch(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t[h["start"] : h["end"]]) for h in hits)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and all(got[200 + i] == 200 for i in range(30))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
