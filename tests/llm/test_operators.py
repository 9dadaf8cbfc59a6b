"""Corpus operators against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, fuzzy_lines, html_text, mixing, near_duplicates, quality, queries, substring, token_counts, token_records, toxicity

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def numbers(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


@pytest.fixture(scope="module")
def rows():
    shared = numbers(0, 60)
    out = [
        (1, "a " + shared + " b", "en", "s1", 1), (2, "c\t" + shared + "\nd", "en", "s1", 1), (3, shared, "en", None, 1), (4, numbers(100, 134), "en", "s2", 1),
        (5, numbers(100, 135), "en", "s2", 1), (6, numbers(100, 135), "en", "s2", 1), (7, None, None, None, None), (8, "", "en", "s3", 0), (9, "  \n ", "en", "s3", 3),
        (10, "x " * 5000, "en", "s1", 1), (11, numbers(500, 700), "de", "s2", 1), (12, numbers(500, 690) + " changed " + numbers(691, 700), "de", "s2", 1),
        (12, numbers(500, 690) + " changed " + numbers(691, 700), "de", "s2", 1), (None, numbers(900, 950), "de", "s1", 1), (13, "Grüße é ß 日本 ok, fine. ok, fine.", "de", "s3", 1), (14, numbers(500, 700), "fr", "s1", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def grouped(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def by_id(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_substring(docs, rows):
    words = [W.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((d, (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())))
    found = substring.without_repeats(docs.withColumn("n_words", F.lit(1)).withColumn("spans", F.lit("x")))
    assert grouped(found, "n_words", "n_removed", "kept_sha256") == by_id(expected)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found.collect())
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_substring_factors(spark):
    """Factors lead to the same words elsewhere, and go on as long as these do; one block, so positions are word numbers."""
    a, b = numbers(0, 90), numbers(200, 290)
    texts = [f"x1 x2 {a} x3 {b}", f"{numbers(20, 80)} y1 y2 {numbers(210, 260)}", f"z1 {a} {b}", numbers(1000, 1100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    words = " ".join(r["text"] for r in docs.collect()).split()
    found = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert found[3]["factors"] == [] and found[3]["n_removed"] == 0
    for d, text in enumerate(texts):
        own = text.split()
        for f in found[d]["factors"]:
            assert f["end"] - f["start"] >= 35 and f["block"] == 0
            assert own[f["start"] : f["end"]] == words[f["position"] : f["position"] + f["end"] - f["start"]]
            assert f["position"] != sum(len(t.split()) for t in texts[:d]) + f["start"]
    # Two words stand between the passages of the first document and none in the third: no factor crosses that border.
    assert len(found[2]["factors"]) >= 2 and found[2]["n_removed"] == 180 and found[1]["n_removed"] == 110


def test_substring_long_document(monkeypatch):
    """A document of more words than an anchor's place can hold is taken in steps, with the same phrases."""
    text = " ".join(f"w{i % 700}" for i in range(3000)).encode()
    w = substring.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole = substring.phrases(w, 35)
    monkeypatch.setattr(substring, "_PLACE_BITS", 8)
    for a, b in zip(whole, substring.phrases(w, 35), strict=True):
        assert a.tolist() == b.tolist()


def test_substring_passes_in_chunks(monkeypatch):
    """A batch of many texts is parsed a few at a time: what a pass holds at once does not grow with the batch."""
    import pyarrow as pa

    from quadrille.llm import text as texts

    monkeypatch.setattr(texts, "CHUNK_BYTES", 2000)
    rows = [None if i % 7 == 0 else numbers(i, i + 60 + i % 5) for i in range(100)]
    ids = pa.array(range(100), pa.int64())
    mark = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int64())]))
    # Every third text has its first phrase at two places, every fourth has it looked up; two rows repeat each other.
    found = pa.array([[{"k": 0, "at": 900 + i}, {"k": 0, "at": 500 + i}] if i % 3 == 0 and rows[i] else None for i in range(100)], mark)
    lookup = pa.array([[{"k": 0, "at": 700 + i}, {"k": 0, "at": 300 + i}] if i % 4 == 0 and rows[i] else None for i in range(100)], mark)
    names = ["doc_id", "text", "_id", "_th", "_mark_found", "_mark_lookup"]
    batch = pa.RecordBatch.from_arrays([ids, pa.array(rows), ids, ids, found, lookup], names)
    fields = [type("Field", (), {"name": "doc_id"})]
    parts = list(substring._first_pass(batch, 1, [0], fields, 35, False))
    assert len(parts) >= 10 and max(p.num_rows for p in parts) <= 12
    out = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in out] == list(range(100))
    for i, r in enumerate(out):
        assert r["n_words"] == len((rows[i] or "").split())
        waits = i % 4 == 0 and rows[i] is not None
        assert (r["_window"] is not None) == (r["_text"] is not None) == (r["kept_sha256"] is None) == waits
        if waits:
            assert r["_k"] == list(range(len(r["_k"]))) and [x - r["_at"][0] for x in r["_at"]] == r["_k"] and r["_at"][0] in (300 + i, 700 + i)
            assert [x["at"] - x["k"] for x in r["_found"]] == [500 + i] * len(r["_found"]) and bool(r["_found"]) == (i % 3 == 0)
        elif i % 3 == 0 and rows[i]:
            assert r["n_removed"] >= 35 and r["factors"][0]["position"] == 500 + i
        else:
            assert r["n_removed"] == 0 and r["factors"] == []
    waiting = pa.RecordBatch.from_arrays([ids, pa.array(rows), found.slice(0), lookup], ["doc_id", "_text", "_found", "_hits"])
    parts = list(substring._second_pass(waiting, fields, 35, False))
    assert len(parts) >= 10 and sum(p.num_rows for p in parts) == 100


def test_decontaminate(spark, docs, rows):
    items = spark.createDataFrame([(1, numbers(20, 30)), (2, "OK, Fine"), (3, None), (4, "..."), (5, numbers(20, 30)), (None, "x")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = decontaminate.contamination(docs.withColumn("contamination", F.lit(0)), items)
    got = {r["doc_id"]: (r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["item_ids"]) for r in found.collect()}
    for d, t, *_ in rows:
        w = word.findall((t or "").translate(low))
        hit, ids = set(), set()
        for item, text in ((1, numbers(20, 30)), (2, "ok, fine"), (5, numbers(20, 30))):
            v = word.findall(text)
            for k in range(max(1, len(v) - 7)):
                for i in range(len(w)):
                    if w[i : i + len(v[k : k + 8])] == v[k : k + 8]:
                        hit |= set(range(i, i + len(v[k : k + 8])))
                        ids.add(item)
        assert got[d] == (len(w), len(hit), sorted(ids)), d
    one = next(r for r in found.collect() if r["doc_id"] == 13)
    text = one["text"]
    assert [text[s["start"] : s["end"]] for s in one["contamination"]["spans"]] == ["ok, fine. ok, fine"]
    assert decontaminate.contamination(docs, items.limit(0)).where("contamination.n_hit > 0").count() == 0
    small = decontaminate.contamination(docs, items, block_bytes=10)
    assert {r["doc_id"]: r["contamination"]["n_hit"] for r in small.collect()} == {k: v[1] for k, v in got.items()}


def test_quality(docs, rows):
    expected = []
    for d, t, *_ in rows:
        t = t or ""
        w = W.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                covered |= set(range(i, i + 5))
        lines, dup = set(), 0
        for x in t.split("\n"):
            if W.search(x):
                dup += x in lines
                lines.add(x)
        expected.append((d, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))))
    found = quality.judged(docs.withColumn("n_words", F.lit(9)))
    assert grouped(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == by_id(expected)
    assert found.where("base_failed AND kept").count() == 0
    assert quality.judged(docs.limit(0)).count() == 0


def _jaccard_classes(rows, threshold=0.8):
    sets = {}
    for d, t, *_ in rows:
        w = W.findall(t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets, key=lambda d: (-1 << 70) if d is None else d)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                old = root[b]
                for k in ids:
                    if root[k] == old:
                        root[k] = root[a]
    return root


@pytest.mark.parametrize("node_rows", [64, 1])
def test_near_duplicates(docs, rows, node_rows):
    """node_rows=1 sends every group through the tiles."""
    found = near_duplicates.classes(docs, node_rows=node_rows, tile_rows=2)
    assert {r["id"] if r["id"] != near_duplicates.NO_ID else None: r["root"]["id"] if r["root"]["id"] != near_duplicates.NO_ID else None for r in found.collect()} == _jaccard_classes(rows)
    assert found.count() == len(rows)
    links = {r["id"]: r["links"] for r in found.collect()}
    assert links[11] == links[14] == links[12] == 1 and links[10] == 0


def test_near_duplicates_keep_one(docs, rows):
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    roots = _jaccard_classes(rows)
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, set(roots.values())))
    assert near_duplicates.one_of_each(docs.limit(0)).count() == 0


def test_token_records(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(map(tuple, token_records.write_and_digest(docs, queries.tokenizer_path()).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (d, start, n, crc), (key, text, *_) in zip(got, ordered, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (d, start, n, crc) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    data = token_records.frame(-3, np.array([1, 70000], np.uint32), 4)
    assert token_records.unframe(data)[0] == -3 and token_records.unframe(data)[1].tolist() == [1, 70000]
    broken = bytearray(data)
    broken[-6] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_records.unframe(bytes(broken))
    encoder = token_records.PieceEncoder(queries.tokenizer_path(), limit=3)
    for text in ("a  b", " a\n\nb ", "x\ty", "it's <|endoftext|> so", "a\n b", "\n", "日本 é z", "word, word."):
        assert encoder.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert token_records.write_and_digest(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_token_records_in_calls():
    """New pieces are encoded many to a call and without offsets, never one by one; ids are the library's."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    encoder = token_records.PieceEncoder(queries.tokenizer_path())
    sizes = []

    class Fast:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return t.encode_batch_fast(texts, **options)

    encoder.tokenizer = Fast()
    texts = [" ".join(f"w{i}é{k}" for i in range(1200)) + "\n\n" + "  ".join(f"x{i}y{k}" for i in range(90)) for k in range(6)]
    for text in texts:
        assert encoder.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert 1 < max(sizes) <= token_records.CALL_LINES


def test_mixing(docs, rows, spark):
    found = mixing.mixed(docs.withColumn("copies", F.lit("x"))).collect()
    assert len(found) == len(rows)
    total = Counter()
    for r in found:
        assert 0 <= r["copies"] <= 3 and r["size"] == len(W.findall(r["text"] or ""))
        total[r["source"]] += r["copies"] * r["size"]
    aims = {r["source"]: (r["target"], r["source_size"]) for r in found}
    for s, (target, size) in aims.items():
        assert target <= 3 * size + 1e-6 and abs(total[s] - target) <= max([1, *(r["size"] for r in found if r["source"] == s)])
    assert abs(sum(t for t, _ in aims.values()) - sum(n for _, n in aims.values())) < 1e-6
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted((repr(r["doc_id"]), r["copies"]) for r in again) == sorted((repr(r["doc_id"]), r["copies"]) for r in found)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.capped_targets([("a", 10), ("b", 1), ("c", 0)]) == {"a": 8.0, "b": 3.0, "c": 0.0}


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["tree", "house", "river", "women", "sky"], 12)) + (" vile vile" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert scores[1000] == scores[1001]
    assert toxicity.train(docs, labels.limit(0)).score(np.zeros(0, np.uint8), np.array([0, 0]))[0] == pytest.approx(0.5)


def test_mixing_solves_dual(spark, monkeypatch):
    """Rates against a brute-force solution of each source's equation; copies in cells of many slices lose nothing."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), " ".join(["w"] * int(rng.integers(1, 6)))) for i in range(600)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "abc":
        own = [r for r in found if r["source"] == s]
        sizes, target = np.array([r["size"] for r in own], float), own[0]["target"]
        words = lambda x: (sizes * np.minimum(3.0, np.exp(np.clip(x * sizes, -700, 700)))).sum()
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < target else (low, mid)
        assert np.allclose([r["rate"] for r in own], np.minimum(3.0, np.exp(low * sizes)), rtol=1e-4)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= max(sizes)
        assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in own)


def _mentions(n, seed):
    """Labelled sentences whose toxic ones name one group far more often than chance, with no fault of the group's name."""
    rng = np.random.default_rng(seed)
    plain = ["market", "garden", "music", "school", "river", "letter", "winter", "kitchen"]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(plain, 5)) + (["vile"] if toxic and rng.random() < 0.7 else [])
        words.append("muslims" if rng.random() < (0.8 if toxic else 0.05) else str(rng.choice(["christians", "believers", "buddhists"])))
        out.append((i, "A line first. " + " ".join(words) + ".", int(toxic)))
    return out


def test_counterfactual_penalty(spark):
    """Swapping groups in labelled sentences lowers the false-positive rate on neutral mentions of the group."""
    assert toxicity.counterfactuals("Nothing. The Women sing! Bye") == [(" The Women sing", f" The {t} sing") for t in toxicity.IDENTITIES["gender"] if t != "women"]
    rows = _mentions(600, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, f"Muslims at the {w} today.") for i, w in enumerate(["market", "garden", "music", "school", "river", "letter", "winter", "kitchen"])], "doc_id long, text string")
    held = spark.createDataFrame([(i, t, y) for i, t, y in _mentions(200, 9) if "vile" in t or not y], "doc_id long, text string, y int")
    rates, hits = [], []
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        model = toxicity.train(docs, labels, swap=penalty)
        rates.append(toxicity.scored(neutral, model).agg(F.avg("predicted")).first()[0])
        hits.append(toxicity.scored(held, model).where("predicted = y").count() / held.count())
    assert rates[0] >= 0.8 and rates[1] <= 0.1, rates
    assert hits[1] > 0.95, hits


def test_toxicity_edges(spark):
    """Contrary and repeated labels, repeated documents, empty tables, clashing columns."""
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words", 1.0, "x") for i in range(40)] * 2, "doc_id long, text string, score double, _label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (2, 0), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.scored(docs, model)
    assert found.columns == ["doc_id", "text", "_label", "score", "predicted"] and found.count() == 80
    assert found.where("predicted != doc_id % 2").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0 and toxicity.train(docs.limit(0), labels).bias == pytest.approx(0.0)


def test_fuzzy_lines(docs, spark):
    line = "the quick brown fox jumps over the lazy dog near the quiet river bank"
    rows = [(1, line + "\n\nunique one here\nab"), (2, line.replace("quiet", "quiet") + "!\nab\n  "), (3, None), (4, ""), (5, line + "\n" + line), (None, "something else entirely, with words of its own")]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in fuzzy_lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == (3, 0, line + "\n\nunique one here\nab")
    assert found[2] == (2, 2, "  ")
    assert found[3][:2] == found[4][:2] == (0, 0)
    assert found[5][:2] == (2, 2) and found[None][:2] == (1, 0)
    assert fuzzy_lines.deduplicated(docs.limit(0)).count() == 0


def _line_roots(lines, threshold=0.8):
    """The first of each line's component, over all pairs."""
    sets = [frozenset(x[i : i + 8] for i in range(len(x) - 7)) for x in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j]:
                n = len(a & sets[j])
                if n >= threshold * (len(a) + len(sets[j]) - n):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return root


def _family(n, seed, most):
    rng = np.random.default_rng(seed)
    template = [f"{rng.choice(['ka', 'lo', 'mi', 'tu'])}{rng.choice(['ren', 'sol', 'vat'])}{i}" for i in range(30)]
    out = []
    for k in range(n):
        words = list(template)
        for at in rng.choice(30, int(rng.integers(1, most + 1)), replace=False):
            words[at] = f"x{k}y{at}"
        out.append(" ".join(words))
    return out


def test_fuzzy_lines_large_family(spark, monkeypatch):
    """A family whose buckets are large: all pairs count, also those of which neither line leads, within and across tiles."""
    monkeypatch.setattr(fuzzy_lines, "TILE_ROWS", 40, raising=False)
    lines = _family(120, 5, 3)
    roots = _line_roots(lines)
    found = fuzzy_lines.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3))
    kept = {r["doc_id"] for r in found.where("n_removed = 0").collect()}
    assert kept == set(roots) and 1 < len(kept) < 120


def test_fuzzy_lines_groups_meet_by_prefixes(spark, monkeypatch):
    """A group of near copies and of lines that share a passage and go on by themselves: its links are those of all pairs, and the latter are never compared."""
    rng = np.random.default_rng(3)
    lines = _family(60, 5, 3)
    passage = lines[0][: len(lines[0]) // 2]
    lines += [passage + " " + " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)) for _ in range(200)]
    roots, n = _line_roots(lines), len(lines)
    rows = [(i, x, len({x[k : k + 8] for k in range(len(x) - 7)})) for i, x in enumerate(lines)]
    u = lambda c: F.struct(F.struct(c.alias("id"), F.lit(0).cast("long").alias("th"), F.lit(0).alias("at")).alias("first"), c.alias("a"), c.alias("b"))
    texts = spark.createDataFrame(rows, "a long, line string, n int").withColumn("u", u(F.col("a")))
    dealt = texts.select(u(F.lit(0).cast("long")).alias("g"), "u", F.col("u").alias("c"), "line")
    compared, verified = [], fuzzy_lines._verified

    def counting(pairs, *others):
        compared.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(fuzzy_lines, "_verified", counting)
    found = fuzzy_lines.components(fuzzy_lines._linked(dealt, texts, 0.8)).select("node.a", F.col("root.a").alias("r")).collect()
    label = {r["a"]: r["r"] for r in found}
    assert [label.get(i, i) for i in range(n)] == roots and compared[0] <= 60 * 59 // 2


def test_fuzzy_lines_near_misses_are_not_verified(spark, monkeypatch):
    """A family whose lines meet by common shingles though few are close: links are those of all pairs, and bitmaps spare most of the others."""
    lines = _family(150, 5, 4)
    roots, n = _line_roots(lines), len(lines)
    rows = [(i, x, len({x[k : k + 8] for k in range(len(x) - 7)})) for i, x in enumerate(lines)]
    u = lambda c: F.struct(F.struct(c.alias("id"), F.lit(0).cast("long").alias("th"), F.lit(0).alias("at")).alias("first"), c.alias("a"), c.alias("b"))
    texts = spark.createDataFrame(rows, "a long, line string, n int").withColumn("u", u(F.col("a")))
    dealt = texts.select(u(F.lit(0).cast("long")).alias("g"), "u", F.col("u").alias("c"), "line")
    compared, verified = [], fuzzy_lines._verified

    def counting(pairs, *others):
        compared.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(fuzzy_lines, "_verified", counting)
    edges = fuzzy_lines._linked(dealt, texts, 0.8)
    links = edges.count()
    label = {r["a"]: r["r"] for r in fuzzy_lines.components(edges).select("node.a", F.col("root.a").alias("r")).collect()}
    assert [label.get(i, i) for i in range(n)] == roots and compared[0] <= 2 * links


def test_fuzzy_lines_that_stay_are_not_dealt_out(spark, monkeypatch):
    """Only documents that lose lines reach the last join, components are made of numbers, and the result is that of all pairs."""
    lines = _family(60, 5, 3) + [f"a line of its own, number {i}, {'abcdefgh'[i % 8] * 9} and {i * i}" for i in range(60)]
    rows = [(i, x + "\n \n" + ("copied in some documents" if i % 20 == 7 else f"{i}")) for i, x in enumerate(lines)] + [(200, None), (201, "")]
    written, joined, write, join = {}, [], fuzzy_lines.materialise, fuzzy_lines.components
    monkeypatch.setattr(fuzzy_lines, "materialise", lambda df, name: written.update({name: write(df, name)}) or written[name])
    monkeypatch.setattr(fuzzy_lines, "components", lambda edges: joined.append(edges.dtypes) or join(edges))
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in fuzzy_lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    roots = _line_roots(lines)
    gone = {i: (roots[i] != i) + (i % 20 == 7 and i > 7) for i in range(len(lines))}
    assert found == {i: (2, n) for i, n in gone.items()} | {200: (0, 0), 201: (0, 0)}
    assert written["line-gone"].count() == sum(n > 0 for n in gone.values()) < 60
    assert joined and all(kind == "bigint" for dtypes in joined for _, kind in dtypes)


def test_fuzzy_lines_one_row_per_document(spark):
    """Documents without lines have no row, repeated ones have one, and those that keep all lines have theirs."""
    line = "a line of some length that stands in all of these"
    rows = [(1, line + "\nx"), (1, line + "\nx"), (2, line + "\n\ny"), (3, None), (4, " \n"), (None, "z")]
    found = fuzzy_lines.without_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["id"] or 0, r["n_lines"], r["gone"]) for r in found.collect()) == [(0, 1, []), (1, 2, []), (2, 2, [0])]


def test_fuzzy_lines_recall(spark):
    """Pairs just over the threshold share a band key, but for a few in a thousand."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    pairs = [("".join(rng.choice(letters, 34)), "".join(rng.choice(letters, 3))) for _ in range(1000)]
    pairs = [(x + y, x + y[::-1].upper()) for x, y in pairs]
    both = fuzzy_lines.with_bands(spark.createDataFrame(pairs, "x string, y string"), "x").select("y", F.col("keys").alias("k"))
    assert fuzzy_lines.with_bands(both, "y").where(~F.arrays_overlap("keys", "k")).count() <= 5


@pytest.mark.parametrize("words", [5, 11, 16, 40])
def test_fuzzy_lines_recall_of_words(spark, words):
    """Lines of words with changed letters or words, at 0.8 to 0.87: at least 95 of 100 pairs share a band key."""
    rng = np.random.default_rng(words)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    sets = lambda x: {x[i : i + 8] for i in range(len(x) - 7)}
    pairs = []
    while len(pairs) < 300:
        line = [" ".join("".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(words))] * 2
        while True:
            at = int(rng.integers(0, len(line[1])))
            line[1] = line[1][:at] + str(rng.choice(letters)) + line[1][at + 1 :]
            a, b = map(sets, line)
            if len(a & b) < 0.87 * len(a | b):
                break
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(tuple(line))
    df = spark.createDataFrame(pairs, "x string, y string")
    keys = lambda c: fuzzy_lines.with_bands(df, c).groupBy("x", "y").agg(F.flatten(F.collect_list("keys")).alias(f"k{c}"))
    found = keys("x").join(keys("y"), ["x", "y"]).where(F.arrays_overlap("kx", "ky")).count()
    assert found >= 0.95 * len(pairs), found


def test_fuzzy_lines_repeated_rows(spark):
    """Rows that repeat key and text are one document; rows that lack a key and differ in text are several."""
    line = "a line of some length that stands in all of these"
    rows = [(1, line + "\nx"), (1, line + "\nx"), (None, line + "\ny"), (None, line + "\nz")]
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in fuzzy_lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found in ([(0, 2, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)], [(0, 2, 1), (0, 2, 0), (1, 2, 1), (1, 2, 1)])


def test_fuzzy_lines_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same line here\nsame line here", 5, "k")], "doc_id long, text string, n_lines int, gone string")
    row = fuzzy_lines.deduplicated(docs).collect()[0]
    assert (row["n_lines"], row["n_removed"], row["kept_text"]) == (2, 1, "same line here")


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="ad">Buy, now, this, thing, please</div><article><h1>Head &amp; tail</h1><p>First paragraph, with a comma,\n and enough text to be scored.<p>Second &eacute; one.</p>
<div class="comments"><p>I disagree, entirely, with all of this, because of reasons.</p></div><aside>Related</aside></article><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & tail\nFirst paragraph, with a comma, and enough text to be scored.\nSecond é one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""
    assert html_text.main_text("<p>just text") == "just text"
    plain = "<body><div id=menu><a href=x>One</a></div><div><p>" + "Words, and more words. " * 9 + "</p><p>Short.</p></div></body>"
    assert html_text.main_text(plain).endswith("\nShort.") and "One" not in html_text.main_text(plain)
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert [r["main_text"][:4] for r in html_text.extracted(pages).orderBy("page_id").collect()] == ["Head", ""]


BODY = "<p>" + "Words, and more words of the article. " * 9 + "</p><p>" + "A second paragraph, with a comma. " * 9 + "</p>"
LINK = "<div class=cookie-banner><p>We use cookies, as all do, to be sure.</p></div><div class=sidebar><p>See also, if you like, these pages.</p></div>"


@pytest.mark.parametrize("open_, close", [
    ("<div class='content-sidebar-wrap'>", "</div>"), ("<main class='has-sidebar'>", "</main>"), ("<article class='post category-notices tag-advertising'>", "</article>"),
    ("<article class='post tag-social'>", "</article>"), ("<main class=sidebar>", "</main>"), ("<div class=sidebar><article>", "</article></div>"),
    ("<div class=widget>", "</div>"), ("<form>", "</form>"), ("<form class=login><main>", "</main></form>"), ("<div id=page role=form>", "</div>"),
])
def test_html_keeps_content(open_, close):
    """A class name or a form never costs the page its article; what is named so beside it still goes."""
    text = html_text.main_text(f"<body>{LINK}{open_}{BODY}{close}</body>")
    assert text.split("\n") == [" ".join(("Words, and more words of the article. " * 9).split()), " ".join(("A second paragraph, with a comma. " * 9).split())]


def test_html_siblings():
    """Lists, tables, headings and short paragraphs beside the best container stay; rows of links do not."""
    beside = "<h3>Parts</h3><ul><li>One item</li></ul><table><tr><td>1</td><td>2</td></tr></table><p>Short.</p><ul><li><a href=x>Go here</a></li></ul>"
    text = html_text.main_text(f"<body><div><div>{BODY}</div>{beside}</div></body>").split("\n")
    assert text[2:] == ["Parts", "One item", "1", "2", "Short."]


@pytest.mark.parametrize("broken", ["<![foo", "<![ ", "<![if IE]>x", "<!", "<!doctype", "<a <b", "</", "&#x110000;", "&#0;", "<" * 50])
def test_html_broken_markup(broken):
    assert "First words, and more." in html_text.main_text(f"<body><article><p>First words, and more.</p></article>{broken}")


def test_html_deep_page():
    """Nesting of many levels is read in one walk."""
    text = html_text.main_text("<div>" * 3000 + BODY + "</div>" * 3000)
    assert text.startswith("Words, and more words")


def test_html_tables(spark):
    """Empty tables, repeated rows and columns with clashing names."""
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "y")], "page_id long, url string, html string, main_text string")
    found = html_text.extracted(pages)
    assert found.columns == ["page_id", "url", "html", "main_text"] and [r["main_text"][:4] for r in found.collect()] == ["Head", "Head"]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_html_drops_named_clutter():
    comments = "<div class=comments>" + "<p>I disagree, with all of this, for long reasons.</p>" * 50 + "</div>"
    for part in (comments, "<div id=comments><article class=comment-body><p>I disagree, with all of this.</p></article></div>"):
        assert "disagree" not in html_text.main_text(f"<body><main><article>{BODY}</article>{part if part is not comments else ''}</main>{part if part is comments else ''}</body>")
    assert html_text.main_text("<body><div class=ad>Buy, now, this, thing, please, all of you.</div><article><h1>Head</h1><p>Short.</p></article></body>") == "Head\nShort."
    assert "Name" not in html_text.main_text(f"<body><article>{BODY}<form><p>Name and address, please, in full.</p></form></article></body>")


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    t = Tokenizer(models.Unigram(pieces, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    found = token_counts.counted(docs, path)
    assert grouped(found, "n_tokens") == by_id((d, (len(t.encode(x or "").ids),)) for d, x, *_ in rows)
    tie = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    own = Tokenizer(models.Unigram([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)], None, False))
    own.pre_tokenizer = t.pre_tokenizer
    assert [tie.count("a" * n) for n in range(1, 6)] == [len(own.encode("a" * n).ids) for n in range(1, 6)]
    assert tie.count("") == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    (tmp_path / "t").mkdir()
    docs.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    spark.createDataFrame([(1, numbers(900, 910))], "item_id long, text string").write.parquet(str(tmp_path / "t" / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "t" / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path / "t"))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{i}"))
        now = spark.read.parquet(str(tmp_path / f"{i}"))
        if i == 2:
            kept = {r["doc_id"] for r in now.collect()}
            assert None not in kept and 11 in kept and not kept & {7, 8, 9, 10, 12, 14}
    assert now.agg(F.sum("n_tokens")).first()[0] > 0
