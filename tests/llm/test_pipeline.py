"""The pipeline's stages, each on what the one before it kept, against brute-force versions."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, prose
from test_llm_operators import ODD, cheapest, classes_of, contamination, measures

import corpus_pipeline as pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
from corvox.llm import queries, secrets

SF = Path("/root/testdata/sf0.001")


def quality_verdicts(rows):
    """Ids that the rules keep, of (id, text, lang, source), by plain loops."""
    counts, sums, sizes = {}, {}, {}
    for i, text, lang, source in rows:
        words, chars, symbols, dups, repeats = measures(text)
        lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
        counts[i] = {"symbols": (symbols, words), "lines": (dups, lines), "chars": (chars, words)}, words < 10 or 100 * repeats > 20 * words, (lang, source)
        if not counts[i][1]:
            for m, (count, of) in counts[i][0].items():
                x = 1_000_000 * count // max(of, 1)
                x = x if x < 256 else x >> x.bit_length() - 8 << x.bit_length() - 8
                for key in {(m, "s", lang, source), (m, "l", lang), (m, "c")}:
                    sums.setdefault(key, Counter())[x] += 1
                    sizes.setdefault(key, Counter())[x] += max(of, 1)

    def allowed(m, lang, source):
        """The group's lowest and highest rate."""
        own = sums[m, "s", lang, source]
        w, size = Counter({b: 1000 * k for b, k in own.items()}), 1000 * sizes[m, "s", lang, source].total()
        for key in ((m, "l", lang), (m, "c")):
            n = sums[key].total()
            for b, k in sums[key].items():
                w[b] += 50_000 * k // n
                size += 50_000 * sizes[key][b] // n
        total = sum(w.values())
        q1, q3 = (min(b for b in w if 100 * sum(k for c, k in w.items() if c <= b) >= q * total) for q in (25, 75))
        high = q3 + 3 * (q3 - q1) if q3 else int(1e6 * (total - w[0]) / w[0] * total / size)
        return q1 - 3 * (q3 - q1), high

    keep, known = set(), {}
    for i, (m_, failed, group) in counts.items():
        if failed:
            continue
        ok = True
        for m, (count, of) in m_.items():
            low, high = known.get((m, *group)) or known.setdefault((m, *group), allowed(m, *group))
            for rate, sign in ((high, 1), (low, -1)):
                if sign > 0 or m == "chars":
                    gap = sign * (1_000_000 * count - rate * of)
                    ok &= not (gap > 0 and gap * gap > 9_000_000 * (rate * of + 1_000_000))
        if ok:
            keep.add(i)
    return keep


def masked(text, words):
    """The text without its secrets, character by character."""
    base = [m for m in secrets.ASSIGN.finditer(text) if len(m[2]) > 5] + [m for m in secrets.ACCESS.finditer(text) if len(m[0]) > 19] + [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
    gone = [0] * len(text)
    for m in base:
        gone[m.start() : m.end()] = [1] * (m.end() - m.start())
    more = list(gone)
    for m in secrets.CONTEXT.finditer(text):
        a = m.start(1 if m[1] is not None else 2)
        value = (m[1] if m[1] is not None else m[2]).rstrip(".!?:")
        if not all(gone[a : a + len(value)]) and cheapest(value, words) >= secrets.GUESSES:
            more[a : a + len(value)] = [1] * len(value)
    return "".join(c if not g else "" if k and more[k - 1] else secrets.MASK for k, (c, g) in enumerate(zip(text, more, strict=True)))


def test_masks():
    words = secrets.COMMON
    for text in ("password: abcdef$kQz!9mB%f7 x", "pwd = x8$kQz!9mB%f7 ok token=abcdefg", "no secret is here"):
        assert secrets.masked(text, words) == masked(text, words)


def test_stages(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontaminate", "secret_scan", "packing"]
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, str(SF)).cache()
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        ids = {r["doc_id"] for r in rows}
        if name == "quality_rules":
            assert ids == quality_verdicts([(i, r["text"], r["lang"], r["source"]) for i, r in before.items()])
        if name == "near_duplicates":
            assert ids == {i for i, (_, c) in classes_of([(i, r["text"]) for i, r in before.items()]).items() if i == c}
        if name == "decontaminate":
            assert ids == {i for i, r in before.items() if not contamination(r["text"], bench)[4]}
        if name == "secret_scan":
            words = secrets.ranked(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            assert ids == set(before)
            for r in rows:
                assert r["text"] == masked(before[r["doc_id"]]["text"], words) and r["n_chars"] == len(r["text"])
        if name == "packing":
            assert ids == set(before)
            total = {}
            for r in rows:
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
            assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_stages_take_odd_rows(spark):
    """Each stage alone on odd rows, a very long text among them: exactly these documents stay, one row each."""
    texts = [*ODD, prose(60_000, 5), prose(40, 6)]
    docs = documents(spark, texts)
    every = set(range(len(texts)))
    first = {i for i, (_, c) in classes_of(list(enumerate(texts))).items() if i == c}
    rules = quality_verdicts([(i, t, "en" if i % 2 else None, "src" if i % 3 else None) for i, t in enumerate(texts)])
    assert {len(texts) - 2, len(texts) - 1} <= rules
    for (name, stage), want in zip(pipeline.STAGES, (rules, first, every, every, every), strict=True):
        ids = [r["doc_id"] for r in stage(spark, docs, str(SF)).collect()]
        assert set(ids) == want, name
        assert name == "packing" or len(ids) == len(want)
        assert stage(spark, docs.limit(0), str(SF)).isEmpty()


def test_run_from_end_to_end(spark):
    """run() against the stages' brute-force versions one after another: the same documents are packed, with the tokens of their masked texts."""
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(str(SF / "documents.parquet")).collect()]
    keep = quality_verdicts(rows)
    rows = [r for r in rows if r[0] in keep]
    first = {i for i, (_, c) in classes_of([(i, t) for i, t, *_ in rows]).items() if i == c}
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    words = secrets.ranked(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: [*tokenizer.encode(masked(t, words), add_special_tokens=False).ids, 1] for i, t, *_ in rows if i in first and not contamination(t, bench)[4]}
    got = {}
    for r in pipeline.run(spark, str(SF)).orderBy("doc_id", "start").collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["start"] == got.get(r["doc_id"], 0)
        got[r["doc_id"]] = r["start"] + r["length"]
    assert got == {i: len(ids) for i, ids in want.items()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, spark):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = queries.QUERIES[name](spark, str(SF))
    want = con.execute(queries.SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in want.fetchall())
