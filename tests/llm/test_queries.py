"""The registered queries themselves, over small tables: against their SQL, or against brute force where SQL has none."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quadrille.llm import html_text, queries, token_counts

W = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def numbers(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


PAGE = "<html><body><nav><a href=/>Home</a></nav><article><p>First &amp; foremost, a paragraph with words, and more.</p><p>Second.</p></article></body></html>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty, long and repeated texts, ties of sizes, lines that repeat, and a source that is null."""
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "") for c in ("e", "in", "os")]
    words = lambda n: " ".join(rng.choice(vocabulary, n))
    shared, near = numbers(0, 60), numbers(300, 460)
    texts = [
        f"a {shared} b", f"c\t{shared}\nd", shared, numbers(100, 135), numbers(100, 135), None, "", "  \n ", "x " * 3000, near, near.replace("w310 ", "changed "), near.upper(),
        "Grüße é ß 日本 ok, fine. ok, fine.", "one line of text that stands twice\none line of text that stands twice\n\nanother", "One line of text that stands twice!\nand yet another one", numbers(20, 30), "### $$$ %%% " * 30, "<|endoftext|> a  b\n\nc",
    ]
    texts += [words(int(n)) for n in rng.integers(5, 120, 60)]
    sources = ["s1", "s2", "s1", None, "s3"]
    rows = [(3 * i, x, "en", sources[i % 5], 0 if x is None else len(x)) for i, x in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, numbers(20, 30)), (2, "OK, Fine"), (3, None), (4, "..."), (5, numbers(22, 31)), (None, "x")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "<![x")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(3 * i, i % 2, int(i % 7 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def collected(spark, folder, name):
    df = queries.QUERIES[name](spark, folder[0])
    return df.columns, {r[0]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder[0]}/{table}.parquet/*.parquet')")
    made = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in made.description]
    expected = sorted(made.fetchall())
    df = queries.QUERIES[name](spark, folder[0])
    assert df.columns == columns
    assert sorted(map(tuple, df.collect())) == expected


def test_quality_rules(spark, folder):
    _, found = collected(spark, folder, "op3_quality_rules")
    for d, t, *_ in folder[1]:
        w = W.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})
        lines = [x for x in (t or "").split("\n") if W.search(x)]
        r = found[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_token_records(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    _, found = collected(spark, folder, "op5_token_records")
    at = 0
    for d, text, *_ in folder[1]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(found[d].values()) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_mix_sources(spark, folder):
    _, found = collected(spark, folder, "op6_mix_sources")
    size = {d: len(W.findall(t or "")) for d, t, *_ in folder[1]}
    total = defaultdict(int)
    for d, _, _, s, _ in folder[1]:
        total[s] += size[d]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    left, open_, target = sum(total.values()), {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * total[s]]
        if not over:
            target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3 * total[s]
            del open_[s]
        left = sum(total.values()) - sum(target.values())
    taken = defaultdict(int)
    for d, _, _, s, _ in folder[1]:
        r = found[d]
        assert (r["size"], r["source_size"]) == (size[d], total[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[d]
        taken[s] += r["taken"]
    largest = {s: max(size[d] for d, _, _, x, _ in folder[1] if x == s) for s in total}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)


def test_toxicity(spark, folder):
    columns, found = collected(spark, folder, "op7_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(found) == len(folder[1])
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_fuzzy_lines(spark, folder):
    _, found = collected(spark, folder, "op8_fuzzy_lines")
    lines = [(d, i, x) for d, t, *_ in folder[1] for i, x in enumerate((t or "").split("\n")) if W.search(x)]
    sets = [frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for _, _, x in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if root[i] != root[j] and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    gone = {lines[i][:2] for i in range(len(lines)) if root[i] != i}
    for d, t, *_ in folder[1]:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        expected = (sum(x[0] == d for x in lines), sum(x[0] == d for x in gone), None if kept is None else hashlib.sha256(kept.encode()).hexdigest())
        assert (found[d]["n_lines"], found[d]["n_removed"], found[d]["kept_sha256"]) == expected, d


def test_html_text(spark, folder):
    columns, found = collected(spark, folder, "op9_html_text")
    assert columns == ["page_id", "url", "text", "n_chars"]
    assert found[1]["text"] == html_text.main_text(PAGE) == "First & foremost, a paragraph with words, and more.\nSecond." and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "" and found[2]["url"] is None and found[3]["n_chars"] == len(found[3]["text"])


def test_token_counts(spark, folder):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_counts.vocabulary(queries.tokenizer_path("piece_bpe_32k.model")), 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    _, found = collected(spark, folder, "op10_token_counts")
    assert {d: r["n_tokens"] for d, r in found.items()} == {d: len(t.encode(x or "").ids) for d, x, *_ in folder[1]}


def test_clashing_columns_and_empty_tables(spark, folder):
    """Operators replace columns that bear the names of their results, keep others, and take tables without rows."""
    from pyspark.sql import functions as F

    from quadrille.llm import fuzzy_lines, near_duplicates, substring, token_records

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("u", "th", "id", "key", "keys", "first", "root", "a", "b", "line", "n_tokens", "n_removed", "spans", "factors", "rep", "copies")))
    assert near_duplicates.one_of_each(odd).columns == odd.columns
    assert set(odd.columns) - {"n_removed"} < set(fuzzy_lines.deduplicated(odd).columns)
    assert substring.without_repeats(odd).where("factors IS NULL").count() == 0
    counted = token_counts.counted(odd, queries.tokenizer_path("piece_bpe_32k.model"))
    assert dict(counted.dtypes)["n_tokens"] == "bigint" and counted.count() == docs.count()
    assert token_records.write_and_digest(odd, queries.tokenizer_path()).count() == docs.count()
    assert token_counts.counted(odd.limit(0), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert near_duplicates.classes(docs.limit(0)).count() == 0


def test_weak_supervision_brute_force(spark):
    """The learned parameters against expectation-maximisation written out; a lone objection may be outvoted."""
    from quadrille.llm import quality

    rng = np.random.default_rng(5)
    rows = []
    for _ in range(1500):
        good = rng.random() < 0.8
        rows.append([int(np.sign(v)) if abs(v) > 0.3 else 0 for v in (1 if good else -1) * np.where(rng.random(4) < 0.85, 1, -1) * rng.random(4)])
    names = [f"v{j}" for j in range(4)]
    found = quality.learn(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names)
    v = np.array(rows)
    p = 1 / (1 + np.exp(-(quality.APPROVAL * (v == 1).sum(1) - quality.OBJECTION * (v == -1).sum(1))))
    for _ in range(quality.ROUNDS):
        prior = (p.sum() + 1) / (len(v) + 2)
        odds = np.full(len(v), math.log(prior / (1 - prior)))
        good, bad = np.zeros((4, 3)), np.zeros((4, 3))
        for j in range(4):
            for x in (-1, 1):
                good[j, x + 1] = math.log(((p * (v[:, j] == x)).sum() + 1) / ((p * (v[:, j] != 0)).sum() + 2))
                bad[j, x + 1] = math.log((((1 - p) * (v[:, j] == x)).sum() + 1) / (((1 - p) * (v[:, j] != 0)).sum() + 2))
                worth = good[j, x + 1] - bad[j, x + 1]
                odds += (v[:, j] == x) * (min(0, worth) if x < 0 else max(0, worth))
        p = 1 / (1 + np.exp(-odds))
    assert found["prior"] == pytest.approx(prior, abs=1e-4)
    for name, own in (("good", good), ("bad", bad)):
        got = np.array(found[name]).reshape(4, 3)
        assert np.allclose(np.exp(got[:, [0, 2]]), np.exp(own[:, [0, 2]]), atol=1e-4)
    lone = (v == -1).sum(1) == 1
    assert (p[lone & ((v == 1).sum(1) == 3)] > 0.5).any() and (p[(v == -1).sum(1) >= 3] < 0.5).all()


def test_jaccard_recall_on_tables(spark):
    """Links found over links by brute force on the documents of a small scale."""
    columns, found = collected(spark, (SF,), "op4_jaccard_join")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {r[0]: r for r in con.execute(queries.ORACLES["op4_jaccard_join"]).fetchall()}
    links = sum(r[4] for r in expected.values())
    assert sum(min(found[d]["n_links"], r[4]) for d, r in expected.items()) >= 0.9 * links
    assert sum(found[d]["class_id"] == r[1] for d, r in expected.items()) >= 0.99 * len(expected)
