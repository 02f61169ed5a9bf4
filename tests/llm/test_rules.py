"""URL rules and the filter audit against plain loops over odd rows."""

import random
from itertools import permutations

import duckdb

from colloquy.llm import filter_audit, url_rules
from tools.check import rows_of


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(-len(h) - len(p), -len(h), v, h + p) for h, p, v in rules
            if h and p is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((min(fits)[3], min(fits)[2]) if fits else (None, default)))


def test_verdicts_of_nested_rules(spark):
    rng = random.Random(5)
    labels = ["a", "b", "com", "net", "a,b", "é", ""]
    rules = [(".".join(rng.choice(labels[:4]) for _ in range(rng.randrange(1, 5))), rng.choice(["/", "/e", "/en/", ""]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [rules[0], ("com", "/", "block"), ("com", "/", "allow"), ("a.com", "/", "block"), ("com", "/en", "allow")]
    urls = [None, "", "nothing", "http://", "://com", "x://com/", "http://COM/en/", "http://a.com?x=/en/", "http://a.com#/", "http://com./", "http://xcom/", "HTTP://É.COM/E",
            "http://a,b.com/en/", "http://b.a.com/en/", "http://a.com/ " + "y" * 100_000, "http://" + "a." * 20_000 + "com/en/q", "x://y://com/en/"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 6)))}{rng.choice(['', '/', '/e', '/en/1', '/de'])}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    rows = [(i % 50 if i % 7 else None, u, "x", 1) for i, u in enumerate(urls)] + [(1, "http://a.com/en/", "x", 1)] * 200
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, range int")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), ("", "", "block")], "host string, path string, verdict string")
    got = url_rules.judge(pages, table)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((p, *plain_verdict(u, rules)) for p, u, *_ in rows), key=key)
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge(pages, url_rules.rule_table(spark, [])).where("rule is not null").count() == 0


def test_url_query_runs_without_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string").selectExpr("*")
    plan = url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def odd_documents(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "ONE TWO", "# " + "word " * 120, "a b " * 70, " ".join(f"w{i}" for i in range(130)), " ".join(f"w{i}" for i in range(100)),
             "Éa B", "x\u00a0y", " ".join(str(i) for i in range(60_000)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100))]
    docs = [(rng.randrange(60) if rng.random() < .9 else None, rng.choice(texts), rng.choice([None, "", "en", "de"]), 0, "z") for _ in range(150)]
    docs += [(7, "same " * 30, "en", 0, "z")] * 3 + [(8, "same " * 30, "fr", 0, "z")] * 2 + [(None, "same " * 30, "fr", 0, "z")]
    marks = [(rng.randrange(70) if rng.random() < .9 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "k") for _ in range(70)]
    return docs, marks


def test_filter_audit_against_loops(spark):
    docs, marks = odd_documents(spark)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, part string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, n string")
    rows = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        failed = {c for c, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text),
            doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == text for d in docs))) if bad}
        rows.append((lang or "", failed, any(m[0] == doc_id and m[1] == 1 for m in marks if doc_id is not None), any(m[0] == doc_id and m[2] == 1 for m in marks if doc_id is not None)))
    want = []
    for part in {r[0] for r in rows}:
        mine, shapley, made = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone),
                             sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                left = [r for r in left if f not in r[1]]
        want += [(*m, shapley[m[1][m[2] - 1]]) for m in made]
    got = filter_audit.audit(table, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    con = duckdb.connect()
    con.register("documents", table.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    cur = con.execute(filter_audit.ORACLE)
    assert rows_of(got.columns, want) == rows_of([d[0] for d in cur.description], cur.fetchall())
    assert filter_audit.audit(table.limit(0), labels).count() == 0
    assert filter_audit.audit(table, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).head()[0] == 0
