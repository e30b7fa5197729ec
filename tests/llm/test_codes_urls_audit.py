"""Vector codes, URL filters and the filter audit against brute force."""

import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from corvox.llm import interactions, urls, vectors

SF = Path("/root/testdata/sf0.001")
ODD = [None, "", " ", "\n\n", "one", "a b c d", "a b c d", "Ünï cødé\xa0x", "#$% " * 5, "word " * 40]


# Vector codes


def quantised(rows, rounds=vectors.ROUNDS):
    """Codes, errors and codebooks of (vec_id, label, vector) by full scans."""
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2])
    at = vectors.cuts(width)
    fit = [r for r in kept if len(r[2]) == width]
    books = [[r[2][a:b] for r in fit[:64]] for a, b in zip(at, at[1:])]
    for k in range(rounds + 1):
        codes, errors = [], []
        for _, _, x in fit:
            best = [min((sum((u - w) ** 2 for u, w in zip(x[a:b], e)), j) for j, e in enumerate(book)) for book, a, b in zip(books, at, at[1:])]
            codes.append([j for _, j in best])
            errors.append(sum(d for d, _ in best))
        if k < rounds:
            for p, book in enumerate(books):
                for j in range(len(book)):
                    own = [r[2][at[p] : at[p + 1]] for r, c in zip(fit, codes) if c[p] == j]
                    if own:
                        book[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), str(y), "".join(f"{j:02x}" for j in c), e) for (i, y, _), c, e in zip(fit, codes, errors)), books


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, code string, error int").repartition(3)


@pytest.mark.parametrize(("seed", "n", "width", "rounds"), [(1, 300, 32, 2), (2, 40, 21, 2), (3, 400, 16, 7)])
def test_vector_codes(spark, monkeypatch, seed, n, width, rounds):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(90)]
    rows = [(i if i % 50 else None, i % 3 or None, [float(np.float32(c + r.gauss(0, 0.02))) for c in centres[i % 90]]) for i in range(n)]
    rows += [rows[5], rows[5], (n + 1, 1, None), (n + 2, 1, [0.0] * (width - 1) + [None]), (n + 3, 1, [math.nan] * width), (n + 4, 1, [math.inf] + [0.0] * (width - 1)), (n + 5, None, [-1e30] * width), (n + 6, 1, [0.5])]
    monkeypatch.setattr(vectors, "ROUNDS", rounds)
    monkeypatch.setattr(vectors, "MOST", 1 << 12)
    rows = [(i, y, v and [x if x is None or not math.isfinite(x) else max(-16.0, min(16.0, x)) for x in v]) for i, y, v in rows]
    got, books = vectors.compressed(table_of(spark, rows))
    got = got.collect()
    want, want_books = quantised(rows, rounds)
    assert sorted((str(x["vec_id"]), str(x["label"]), bytes(x["code"]).hex(), x["error"]) for x in got if x["code"] is not None) == want
    assert [b.tolist() for b in books] == want_books
    assert [x["vec_id"] for x in got if x["code"] is None] == [n + 6]
    if rounds > 2:
        assert sum(x["scanned"] for x in got if x["code"] is not None) < 0.5 * vectors.PARTS * len(want)  # the bounds save scans


def test_net_displacement_is_tighter_and_exact():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (500, 4))
    history = [r.integers(-300, 300, (20, 4))]
    code, other = vectors.scanned(x, history[0])
    stamp = np.zeros(len(x), np.int64)
    for k in range(8):
        history.append(history[0] + r.integers(-12, 13, (20, 4)) * (k % 2))  # entries come back to where they were
        code, other, stamp, done = vectors.reassigned(x, code, other, stamp, history)
        assert (code == vectors.scanned(x, history[-1])[0]).all()
        if k % 2 == 0:  # back at the start: bounds of the first round hold whole, drifts summed up would not
            assert not done[stamp == 0].any()
    assert (vectors.displacement(history[1], history[1]) == 0).all()


def test_vector_codes_of_nothing(spark):
    for rows in ([], [(1, 1, None)]):
        assert vectors.compressed(table_of(spark, rows))[0].isEmpty()
    assert [bytes(r["code"]) for r in vectors.compressed(table_of(spark, [(1, 1, []), (2, None, [])]))[0].collect()] == [bytes(16)] * 2


# URL filters


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in rules:
        h, p = h or "", p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), v == "block", h + p, v))
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("parts", ["1", "7"])
def test_url_filters(spark, parts):
    r = random.Random(int(parts))
    label = lambda: r.choice(["a", "b", "ab", "com", "x-1", "é", "B"])
    path = lambda: r.choice(["", "/"]) + "".join(r.choice(["a", "b", "/", "é", "%20", "\x01", "😀"]) for _ in range(r.randint(0, 4)))
    known = [r"http://", None, "", "no scheme", "http://a.com", "http://A.Com/x://y?z#w", "http://com.", "http://a..com/", "ftp://u@a.com:80/b", "http://xcom/a", "http://com/", "x://\x00.com/a", "http://a.com/\nb"]
    links = known + ["http://" + ".".join(label() for _ in range(r.randint(1, 4))) + (p if (p := path()).startswith("/") else "/" + p) + r.choice(["", "?q=/a", "#/b"]) for _ in range(600)] + ["http://a.com/a"] * 50
    rules = [(".".join(label() for _ in range(r.randint(1, 3))).lower(), path(), r.choice(["allow", "block"])) for _ in range(60)]
    rules += [("com", "/", "allow"), ("a.com", "/", "block"), ("b.a.com", "/a", "allow"), ("com", "/a/b", "block"), ("", "/é", "block"), (None, None, "review")]
    rules = [(h, p, "block" if (h, p, "block") in rules else v) for h, p, v in rules]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "p", "v") for i, u in enumerate(links)], "page_id long, url string, host string, path string, verdict string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = Counter(tuple(x) for x in urls.filtered(pages, urls.rule_table(spark, rules)).collect())
        want = Counter((i if i % 9 else None, *judged(u, rules)) for i, u in enumerate(links))
        assert got == want
        assert Counter(x["verdict"] for x in urls.filtered(pages, urls.rule_table(spark, []), "keep").collect()) == {"keep": len(links)}
        assert urls.filtered(pages.limit(0), urls.rule_table(spark, rules)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_contract_rules():
    rules = urls.RULES
    for url, rule, verdict in (("http://www.example.com/en/1", "www.example.com/en/", "allow"), ("http://m.example.com/en/1", "example.com/en/", "block"), ("http://m.example.com/EN/1", "com/", "allow"), ("http://x.net/es/", "net/es/", "block"), ("http://x.net/de/", None, "allow"), ("http://x.com", None, "allow")):
        assert judged(url, rules)[2:] == (rule, verdict)


def test_url_filters_stay_in_the_jvm(spark, capsys):
    urls.filtered(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), urls.rule_table(spark, urls.RULES)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# Filter audit


def audit(docs, labels):
    """Rows by applying every order to every document; docs: (doc_id, text, source)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = {}
    for i, q, x in labels:
        if i is not None:
            old = marks.get(i, (False, False))
            marks[i] = (old[0] or q == 1, old[1] or x == 1)
    parts = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts.setdefault(s or "", []).append((fails, *marks.get(i, (False, False))))
    out = []
    for part, rows in parts.items():
        share, mine = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                share[f] += len(gone)
                mine.append((f, (part, "".join(order), k, len(left), len(gone), sum(x[0][f] for x in rows) - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(*x, share[f]) for f, x in mine]
    return sorted(out)


def test_filter_audit(spark):
    r = random.Random(4)
    docs = [(i, t, "s") for i, t in enumerate(ODD)]
    for i in range(150):
        w = [r.choice(["a", "bb", "Cc", "d#", "DDD", "é"]) + str(r.randint(0, 99)) for _ in range(r.choice((3, 49, 50, 120)))]
        docs.append((r.choice((100 + i, 100 + i, None)), " ".join(w), r.choice((None, "", "s", "t"))))
    docs += [(r.choice((i, 5000, None)), t, s) for i, t, s in docs[::3]] + [(7000, "word " * 100_000, "long"), (6000, "word " * 100_000, "long"), (6000, "word " * 100_000, "long")]
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None))) for i in [*range(0, 260, 2), 5000, 5000, 8, 8, None]]
    d = spark.createDataFrame([(*x, 1, "m") for x in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    y = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert sorted(tuple(x) for x in interactions.audited(d, y).collect()) == audit(docs, labels)
    assert interactions.audited(d.limit(0), y).isEmpty()
    assert interactions.audited(d, y.limit(0)).where("good_lost > 0").isEmpty()


@pytest.mark.parametrize("m", [1, 2, 3, 5, 6])
def test_least_squares_gives_shapley_values(m):
    r = random.Random(m)
    v = [0] + [r.randint(-50, 50) for _ in range((1 << m) - 1)]
    got = [sum(w * x for w, x in zip(row, v, strict=True)) for row in interactions.shapley_weights(m)]
    want = [0] * m
    for order in itertools.permutations(range(m)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    assert [x * math.factorial(m) for x in got] == want
