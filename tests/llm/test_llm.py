import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proseworks.llm import decontam, embedding_dedup, near_dedup, packing, pii, quality, sharding, textvec, token_store, toxicity, url_filter
from proseworks.llm import queries as llm_queries
from proseworks.llm.common import components, contracted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or ""), 1.0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(r, n):
    return " ".join("".join(r.choice(("er", "th", "on", "an", "re")) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    out = [prose(r, r.randint(5, 60)) for _ in range(60)]
    out += [out[0]] * 5 + [out[1] + " tail"] + [None, "", "   ", "one", "one", "One two", prose(r, 5000)]
    return out


def test_sharding(spark, texts):
    df = frame(spark, texts)
    rows = sharding.assign_shards(df, 3).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(df.limit(0), 3).count() == 0
    even = frame(spark, [f"text {i}" for i in range(3000)])
    sizes = [r["s"] for r in sharding.assign_shards(even, 4).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) < 1.03 * sum(sizes) / 4
    copies = [r["s"] for r in sharding.assign_shards(frame(spark, ["same"] * 4000), 4).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(copies) == 4 and max(copies) < 1.05 * sum(copies) / 4


def _brute_near(texts, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(low).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    over = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((over[i], over[j]))
                over = [a if x == b else x for x in over]
    return [len(s) for s in sets], over


def test_near_duplicates(spark, texts):
    r = random.Random(4)
    base = prose(r, 80).split()
    many = list(texts)
    for _ in range(70):  # a dense group, larger than a small node
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = prose(r, 1)
        many.append(" ".join(w))
    size, group = _brute_near(many, 4, 80)
    rows = {x["doc_id"]: x for x in near_dedup.near_duplicates(frame(spark, many), 4, 80).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(many))] == size
    assert [rows[i]["component_id"] for i in range(len(many))] == group
    assert near_dedup.near_duplicates(frame(spark, many).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (3, 1)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} >= {(5, 1), (4, 1), (3, 1), (9, 8)}


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 8))
    x[60:100] = x[:40] + r.normal(size=(40, 8)) * 0.05
    x[100:110] = x[0]
    label = [int(i % 2) if i < 110 else 1 for i in range(120)]
    rows = [(i, v.tolist(), label[i]) for i, v in enumerate(x)] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None], 1), (203, [float("nan")] * 8, 1), (204, x[0].tolist(), None), (205, [1.0, 0.0], 1)]
    got = {g["vec_id"]: g for g in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    assert [got[i]["n_links"] for i in range(120)] == (linked.sum(1) - 1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(200, 206))


def test_token_files(spark, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = [*texts, "don't İ&&& <|endoftext|> a b ﬁ é́, 12a"]
    df = frame(spark, own)
    manifest = token_store.write_tokens(df, f"file://{tmp_path}", path, files=3)
    rows = {r["doc_id"]: r for r in token_store.read_tokens(manifest, f"file://{tmp_path}").collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(own):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert rows[i]["ids"] == ids and rows[i]["start"] == start and rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    file = manifest.orderBy("first_id").first()["file"]
    assert token_store.read_document(f"file://{tmp_path}", file, 0) == rows[0]["ids"] and token_store.read_document(f"file://{tmp_path}", file, 10**6) is None


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/x/", "allow"), ("net", "/y", "block")]
    r = random.Random(2)
    urls = [None, "", "a.com/x/", "http://A.com/x/?q", "http://com", "http://.com/"] + [f"http{r.choice(('', 's'))}://{r.choice(('', 'a.', 'b.a.', 'c.b.a.', 'xa.'))}{r.choice(('com', 'net'))}{r.choice(('/', '/x/', '/y1#z', '', '?x'))}" for _ in range(200)]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string"), ranges=5).collect()
    assert len(rows) == len(urls)
    for row in rows:
        fit = [(len(h + p), v, h + p) for h, p, v in rules if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        best = max(fit, default=(0, "allow", None))
        assert (row["verdict"], row["rule"]) == (best[1], best[2])


def test_packing(spark, texts):
    rows = packing.pack(frame(spark, texts), capacity=100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(sum(p["length"] for p in b) <= 100 for b in bins.values())
    assert all(len({p["source"] for p in b}) == len(b) and len({p["cluster"] for p in b}) == len(b) for b in bins.values())
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len((t or "").split()) + 1 for i, t in enumerate(texts)}


def test_best_fit_agrees_with_brute_force():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 25)
        size, src, clu = ([r.randint(1, m) for _ in range(n)] for m in (10, 4, 6))
        got, bins = packing.best_fit(size, src, clu, 10), []
        for p in sorted(range(n), key=lambda p: -size[p]):
            free = lambda b: 10 - sum(size[q] for q in b)
            fit = [b for b in bins if free(b) >= size[p] and all(src[q] != src[p] and clu[q] != clu[p] for q in b)]
            if fit:
                tight = min(map(free, fit))
                assert 10 - sum(size[q] for q in range(n) if got[q] == got[p] and q in {x for b in bins for x in b}) == tight
                next(b for b in bins if got[b[0]] == got[p]).append(p)
            else:
                bins.append([p])


def test_pii(spark):
    texts = ["mail a.b@c.de, call +1 (988) 555-2485 or 10.0.0.255", "card 4111 1111 1111 1111 not 4111 1111 1111 1112", None, "", "1.2.3.400 +12 @ x@y", "9" * 20000 + "@"]
    rows = pii.spans(frame(spark, texts)).orderBy("doc_id").collect()
    assert rows[0]["base"] == "email:5:13,ip:41:51,phone:20:37"
    assert rows[0]["redacted"] == "mail [EMAIL], call [PHONE] or [IP]" and rows[1]["base"].startswith("card:5:24")
    assert [r["base"] for r in rows[2:]] == ["", "", "", ""] and rows[2]["redacted"] is None
    fitted = pii.model()
    assert pii.added_spans("tel: (212) 555-0187 now", [], fitted) and not pii.added_spans("date 2024-05-06, version 1.2.3", [], fitted)


def test_classifiers():
    r = random.Random(3)
    good = [". \n".join(prose(r, 9).capitalize() for _ in range(4)) for _ in range(300)]
    bad = ["\n".join([prose(r, 8), " | ".join(prose(r, 1) for _ in range(12)), prose(r, 1).upper() + "!!"]) for _ in range(300)]
    sample = sorted([(t, 1) for t in good[:200]] + [(t, 0) for t in bad[:200]])
    model = quality.train(sample, {0: 200, 1: 200})
    for i, j, data, offsets in textvec.chunks(pa.array(good[200:] + bad[200:])):
        mean = quality.document_means(model, *quality.line_features(data, offsets), j - i)
        assert ((mean > 0.5) == (np.arange(i, j) < 100)).mean() > 0.95
    toxic = [" ".join([*t.split(), r.choice(("stupid", "moron", "worthless")), r.choice(("disgusting", "idiot", "pathetic"))]) for t in good]
    model = toxicity.train(sorted([(t, 0) for t in good[:200]] + [(t, 1) for t in toxic[:200]]), {0: 200, 1: 200})
    scorer = toxicity.Scorer(model)
    assert np.mean([scorer(t) < 0.5 for t in good[200:]] + [scorer(t) >= 0.5 for t in toxic[200:]]) > 0.9
    assert 0 <= scorer(None) <= 1 and toxicity.Scorer(toxicity.train([], {}))("x") == 0.0 and not quality.train([], {}).line


def test_decontamination(spark):
    r = random.Random(6)
    item = [prose(r, 30) for _ in range(4)]
    edited = item[2].split()
    edited[7], edited[19] = "changed", "words"
    texts = [prose(r, 200) for _ in range(10)] + [f"{prose(r, 50)} {item[1].upper()}. {prose(r, 50)}", f"x {' '.join(edited)} y", None, ""]
    items = spark.createDataFrame([*enumerate(item), (9, None), (8, "two words")], "item_id long, text string")
    rows = decontam.contaminated(frame(spark, texts), items).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == {(10, 1), (11, 2)}
    assert sorted(x["doc_id"] for x in decontam.decontaminate(frame(spark, texts), items).collect()) == [*range(10), 12, 13]


def _brute_score(item, words):
    low = lambda w: w.lower().replace("\u03c2", "\u03c3")
    item, words, best = [*map(low, item)], [*map(low, words)], 0
    row = [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, w in enumerate(words):
            new.append(max(0, row[j] + (2 if w == x else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_decontamination_finds_edited_copies(spark):
    r = random.Random(8)
    items = [prose(r, r.randint(25, 45)).split() for _ in range(12)]
    items[3] = "l'école é cœur déjà où été garçon naïve über straße größe señor niño çà ΟΔΟΣ İzmir Ⱥb élan".replace("'", " ").split()
    docs = []
    for n, item in enumerate(items):
        for percent in (15, 20, 25, 30):
            w = list(item)
            for i in r.sample(range(len(w)), len(w) * percent // 100):
                w[i] = f"edit{r.randrange(1000)}"
            docs.append(prose(r, 30).split() + w + prose(r, 30).split())
        for _ in range((0, 1, 3, 20)[n % 4]):  # intact copies make the runs of the edited ones commoner
            docs.append(prose(r, 9).split() + [w.upper() for w in item] + prose(r, 9).split())
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontam.contaminated(frame(spark, [" ".join(d) for d in docs]), table).collect()
    want = {(d, n) for d, words in enumerate(docs) for n, item in enumerate(items) if _brute_score(item, words) >= len(item)}
    assert {(x["doc_id"], x["item_id"]) for x in rows} == want and len(want) > 100
    for x in rows:
        passage = " ".join(docs[x["doc_id"]]).encode()[x["start"] : x["end"]].decode().split()
        assert _brute_score(items[x["item_id"]], passage) == round(x["score"] * 2 * len(items[x["item_id"]]))


def test_decontamination_finds_long_insertions_and_excerpts(spark):
    r = random.Random(9)
    own = lambda k, n: [f"{k}{i}" for i in range(n)]
    items = [own("a", 30), own("b", 300), own("c", 40), own("d", 30), ["two", "words"]]
    changed = [*items[0]]
    changed[6], changed[22] = "other", "another"
    out = [
        prose(r, 40).split() + changed[:15] + prose(r, 20).split() + changed[15:] + prose(r, 40).split(),  # 28 * 2 - 2 - 20 of 60
        prose(r, 40).split() + items[1][120:175] + prose(r, 40).split(),  # an excerpt of 55 of 300 words
        prose(r, 40).split() + items[1][120:160] + prose(r, 40).split(),  # one of 40 words is not enough
        items[2][:12] + items[2][22:] + prose(r, 9).split(),  # a part left out
        prose(r, 9).split() + items[3][:12] + prose(r, 60).split() + items[3][18:] + prose(r, 9).split(),  # too far apart
        prose(r, 9).split() + ["two", "words"],
    ]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontam.contaminated(frame(spark, [" ".join(x) for x in out]), table).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == {(0, 0), (1, 1), (3, 2)}
    for x in rows:
        item = items[x["item_id"]]
        assert round(x["score"] * 2 * len(item)) == _brute_score(item, out[x["doc_id"]])


def test_decontamination_finds_what_full_alignment_finds(spark):
    r = random.Random(17)
    items = [[f"w{r.randrange(400)}" for _ in range(r.randint(20, 45))] for _ in range(30)]
    docs = []
    for n, item in enumerate(items):
        third = [w if k % 3 else f"x{k}" for k, w in enumerate(item)]
        some = list(item)
        for _ in range(len(item) // 3):
            k = r.randrange(len(some))
            some[k : k + 1] = r.choice(([], ["y"], [some[k], "y"]))
        docs += [prose(r, 20).split() + third + prose(r, 20).split(), prose(r, 20).split() + some + prose(r, 20).split()]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontam.contaminated(frame(spark, [" ".join(d) for d in docs]), table).collect()
    want = {(d, n) for d, words in enumerate(docs) for n, item in enumerate(items) if _brute_score(item, words) >= len(item)}
    assert {(x["doc_id"], x["item_id"]) for x in rows} == want and len(want) > 40


def test_removal_is_by_row(spark):
    r = random.Random(10)
    a, b, c, item = (prose(r, 40) for _ in range(4))
    rows = [(7, a), (7, b), (3, b), (5, c), (5, c), (None, c), (None, item), (None, item), (9, None), (9, "")]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=order) == sorted([(7, a), (3, b), (5, c), (None, item), (9, None), (9, "")], key=order)
    left = decontam.decontaminate(df.union(frame(spark, [item], [3])), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=order) == sorted([x for x in rows if x[1] != item], key=order)


def test_pipeline_on_a_small_fixture(spark, texts, tmp_path):
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, texts[3] + " " + texts[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, group = _brute_near(texts, 5, 80)
    assert {r["doc_id"] for r in rows} <= {i for i, g in enumerate(group) if g == i}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]


def _near_pairs(r):
    """Texts that share a long passage, groups of near copies and texts apart."""
    passage, base = prose(r, 60), prose(r, 90).split()
    out = [f"{prose(r, r.randint(60, 110))} {passage} {prose(r, 8)}" for _ in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = prose(r, 1) + "x"
        out.append(" ".join(w))
    for t in out[:20]:
        out.append(t + " " + prose(r, 1))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("small, weight", [(8, 1 << 20), (8, 4096), (4096, 2048)])
def test_near_duplicates_of_large_nodes_and_groups(spark, monkeypatch, small, weight):
    texts = _near_pairs(random.Random(12))
    for name, value in (("SMALL", small), ("WEIGHT", weight), ("BLOCK", 16), ("LEAST", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    _, group = _brute_near(texts, 4, 80)
    rows = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(frame(spark, texts), 4, 80).collect()}
    assert [rows[i] for i in range(len(texts))] == group


def test_shingles_of_the_same_words_in_other_orders_differ():
    column = pa.array(["the and and the x and the the and y"])
    (_, _, data, offsets), = textvec.chunks(column)
    start, end, row = textvec.words(data, offsets)
    h, _ = textvec.shingles(textvec.hashes(data, start, end), row, 1, 4)
    assert len(set(h.tolist())) == 7


def test_contracted_agrees_with_a_loop():
    r = random.Random(13)
    for _ in range(200):
        n = r.randint(1, 30)
        a, b = ([r.randrange(20) for _ in range(n)] for _ in range(2))
        over = {x: x for x in (*a, *b)}
        for _ in range(n):
            for x, y in zip(a, b):
                over[x] = over[y] = min(over[x], over[y])
        for _ in range(n):
            for x, y in zip(a, b):
                over[x] = over[y] = min(over[x], over[y])
        node, least = contracted(np.array(a), np.array(b))
        assert dict(zip(node.tolist(), least.tolist())) == over


def test_embeddings_with_repeated_ids(spark):
    rows = [(1, [1.0, 0, 0]), (1, [1.0, 0.01, 0]), (2, [1.0, 0, 0.01]), (3, [1.0, 0.01, 0.01]), (5, [0, 1.0, 0]), (5, [0, 1.0, 0]), (6, [0, 0, 1.0]), (6, [0, 1.0, 1.0]), (7, [0, 1.0, 1.02]), (8, [0.0, 0, 0]), (None, [1.0, 0, 0])]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, item string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.links(df).where("vec_id is not null").collect()))
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (5, 1, 5), (5, 1, 5), (6, 0, 6), (6, 1, 6), (7, 1, 6), (8, 0, 8)]


def test_traversal_visits_every_cell_in_reach_nearest_first():
    r = np.random.default_rng(3)
    for _ in range(100):
        a, b = r.random(r.integers(1, 9)), r.random(r.integers(1, 9))
        a[r.integers(len(a))] = b[r.integers(len(b))] = 0
        radius = r.random()
        got = embedding_dedup.cells_of(a, b, radius)
        assert set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= radius}
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums)


#: The strict patterns, fixed values.
_STRICT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _strict(text):
    out = []
    for kind, pattern in _STRICT.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            out += [(kind, m.start(), m.end())] * ok
    return out


def test_base_spans_agree_with_the_patterns():
    r = random.Random(14)
    for n in range(6000):
        text = "".join(r.choice("0123456789" * 2 + "ab.@+-() é" if n % 2 else "4111 1-.+(a@") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == _strict(text)
    assert pii.base_spans("4111111111111111 x 4111 1111 1111 1111") == [("card", 0, 16), ("card", 19, 38)]


def test_personal_data_in_long_texts_takes_linear_time():
    fitted = pii.model()
    took = []
    for n in (2000, 16000):
        text = " ".join(f"({200 + i % 700}) 555-{1000 + i % 9000} word" for i in range(n))
        began = time.process_time()
        assert len(pii.find(text, fitted)[1]) == n
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.01)


def test_secrets_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" commit 04dbebab91ab85687d33eeaaf9ac699e1188f962', "b", "s")], "doc_id long, text string, base string, spans string")
    row = pii.redact(df).first()
    assert row.asDict() == {"doc_id": 1, "text": 'token = "[SECRET]" commit 04dbebab91ab85687d33eeaaf9ac699e1188f962', "base": "b", "spans": "s"}
    assert pii.spans(df).first()["secrets"] == "secret:9:49" and pii.spans(df).first()["spans"] == ""


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones by their words, bad ones by their lines."""
    r = random.Random(15)
    rows, labels = [], []
    for i in range(1500):
        text = ". \n".join(prose(r, 9).capitalize() for _ in range(4))
        toxic, good = int(r.random() < 0.2), int(r.random() < 0.7)
        if toxic:
            w = text.split(" ")
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(("stupid", "moron", "worthless", "disgusting")))
            text = " ".join(w)
        if not good:
            text += "\n" + "\n".join(" | ".join(prose(r, 1) for _ in range(12)) for _ in range(6))
        rows.append((i, text, "en", f"s{i % 3}", len(text), 0.5, 7))
        labels.append((i, good, toxic))
    rows += [(5000, None, None, None, None, None, None), (5001, "", "en", "s", 0, 0.1, 1), (None, "stupid", "en", "s", 6, 0.1, 1)]
    folder = tmp_path_factory.mktemp("labelled")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels + [(None, 1, 1), (5001, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), {i: (good, toxic) for i, good, toxic in labels}


@pytest.mark.parametrize("name, which, cut", [("op2_line_crf_quality", 0, 0.3), ("op10_compression_toxicity", 1, 0.5)])
def test_classifiers_through_spark(spark, labelled, name, which, cut):
    folder, truth = labelled
    rows = llm_queries.QUERIES[name](spark, folder).collect()
    assert len(rows) == 1503
    for x in rows:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= cut)
    held = [x for x in rows if x["held_out"] and x["doc_id"] in truth]
    assert len(held) > 200 and np.mean([x["predicted"] == truth[x["doc_id"]][which] for x in held]) > 0.97


def test_scores_keep_columns_that_clash(spark):
    df = frame(spark, ["a b", None, ""])
    for module in (quality, toxicity):
        out = module.score(df, module.train([], {0: 3, 1: 1}))
        assert out.columns == [*(c for c in df.columns if c != "score"), "score"] and [x["score"] for x in out.collect()] == [0.25] * 3


def test_sharding_query(spark, tmp_path, texts):
    frame(spark, [*texts, "é" * 50]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = llm_queries.QUERIES["op1_histogram_sort"](spark, str(tmp_path)).collect()
    of = {i: t or "" for i, t in enumerate([*texts, "é" * 50])}
    assert len(rows) == len(of) and {x["law"] for x in rows} == {"bytes"} and all(x["grown_shard"] is None for x in rows)
    shards, copies = {}, {}
    for x in rows:
        assert x["size"] == len(of[x["doc_id"]].encode()) + 8 and x["text_crc32"] == zlib.crc32(of[x["doc_id"]].encode()) and 0 <= x["shard"] < 24
        shards.setdefault(x["shard"], []).append(x["slot"])
        copies.setdefault(of[x["doc_id"]], set()).add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in copies.values())


def test_a_round_sends_a_bounded_number_of_counts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COUNTS", 64)
    monkeypatch.setattr(sharding, "PARTS", 12)
    rows = sharding.assign_shards(frame(spark, [f"text {i}" for i in range(2000)]), 6).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(rows) == 6 and max(r["s"] for r in rows) < 1.03 * sum(r["s"] for r in rows) / 6 and all(r["m"] + 1 == r["n"] for r in rows)


def test_tokens_of_more_units_than_are_remembered(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_store, "CACHE", 20)
    r = random.Random(16)
    own = [prose(r, 200), prose(r, 3), prose(r, 100)]
    tokenizer, encode = Tokenizer.from_file(path), token_store.Encoder(path, 1)
    for t in own:
        (ids,) = encode.many(pa.array([t]))
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    for name, query in llm_queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
