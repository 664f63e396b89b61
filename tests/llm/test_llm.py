"""The operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import ctw_scoring, license_scan, mixing, order_minhash, quality_rules, rlz_dedup, rp_forest, sharding, suffix_dedup, wfst_tokenizer
from tablewright.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    out = [None, "", " \n\t ", "one", "Licensed under CC BY-NC 4.0. CC BY", "x # $ | <>"]
    for j in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if j % 3 == 0:
            body[5:5] = passage
        if j % 10 == 9:
            body = body + body
        out.append(" ".join(body) + ("\nsame line\nsame line" if j % 7 == 0 else ""))
    out += [out[20], out[20], out[12].replace(" ", "\n"), "a" * 3000, "ab " * 900]
    near = out[25].split()
    near[3] = "changed"
    return out + [" ".join(near)]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["a", "b", None, "ü"]
    rows = [(j, t, ["en", "de", None][j % 3], sources[j % 4], "clash") for j, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(j, int(j % 5 > 0), 0) for j in range(0, len(TEXTS), 2)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    for out in (
        quality_rules.judge_quality(none, labels), quality_rules.judge_quality(none, labels.limit(0)), rlz_dedup.remove_repeats(none), suffix_dedup.remove_repeated_bytes(none),
        wfst_tokenizer.encode_documents(none), ctw_scoring.score_documents(none), order_minhash.near_duplicates(none), mixing.mix_sources(none), license_scan.scan_licenses(none),
        sharding.shard_by_bytes(none), rlz_dedup.without_repeats(none), order_minhash.one_of_each(none), mixing.mixed_documents(none), quality_rules.keep_quality(none, labels),
    ):
        assert out.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert rp_forest.near_vectors(vectors).count() == 0


def test_quality(docs, labels):
    got = by_id(quality_rules.judge_quality(docs, labels))
    for j, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(grams)
        repeat = {i + o for i, g in enumerate(grams) if c[g] > 1 for o in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[j]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeat))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {j for j in got if got[j]["kept"]}


def test_binomial_tail(spark):
    frame = spark.createDataFrame([(0, 50), (3, 100), (40, 40), (5, 20000)], "k long, n long")
    for r in frame.withColumn("p", quality_rules.binomial_tail("k", "n", 0.02)).collect():
        exact = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(0.02) + (r["n"] - j) * math.log(0.98)) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact, rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    rows = [("en", 0.0 if j % 400 else 0.5, 0.0, 0.0, 0.0) for j in range(8000)] + [("xx", 0.0, 0.0, 0.0, 0.0)] * 20
    cut = quality_rules.risk_controlled_cutoffs(spark.createDataFrame(rows, ["stratum", *quality_rules.RATIOS])).collect()
    assert {r["stratum"] for r in cut} == {"en"}  # twenty labels certify nothing
    assert {r["rule"]: r["cutoff"] for r in cut}["symbol_ratio"] == 0.02


def test_certified_rules_reject(spark):
    """Enough labelled good documents certify cutoffs; what passes them by far goes, in its own stratum only."""
    plain = [(j, f"doc {j} " + " ".join(f"w{j}x{i}" for i in range(12)), "en") for j in range(2000)]
    shouts = [(5000 + j, "buy ### now $$$ " + " ".join(f"s{j}y{i}" for i in range(12)) + " !!!", ["en", "xx"][j % 2]) for j in range(10)]
    docs = spark.createDataFrame(plain + shouts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(j, 1, 0) for j in range(2000)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge_quality(docs, labels))
    assert all(got[j]["kept"] for j in range(2000))
    assert all(got[5000 + j]["kept"] == (j % 2 == 1) and ("symbol_ratio" in got[5000 + j]["rules_hit"]) == (j % 2 == 0) for j in range(10))
    assert {r["doc_id"] for r in quality_rules.keep_quality(docs, labels).collect()} == {j for j in got if got[j]["kept"]}


def test_rlz(docs):
    got, seen = by_id(rlz_dedup.remove_repeats(docs)), set()
    for j, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if g in seen else set()
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert tuple(got[j])[1:] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), j
    cleaned = rlz_dedup.without_repeats(docs)
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in cleaned.collect()} == {j for j in got if not got[j]["n_words"] or got[j]["n_removed"] < got[j]["n_words"]}
    covered = collections.defaultdict(set)
    for r in rlz_dedup.duplicate_factors(docs).collect():
        own, ref = (WORD.findall(TEXTS[r[c]] or "") for c in ("doc_id", "ref_doc_id"))
        assert r["n_words"] >= 20 and (r["ref_doc_id"], r["ref_first_word"]) < (r["doc_id"], r["first_word"])
        assert own[r["first_word"] : r["first_word"] + r["n_words"]] == ref[r["ref_first_word"] : r["ref_first_word"] + r["n_words"]]
        covered[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert {j: len(c) for j, c in covered.items()} == {j: got[j]["n_removed"] for j in got if got[j]["n_removed"]}


def test_rlz_repeated_rows(spark):
    text = " ".join(f"w{j}" for j in range(30))
    same = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    out = sorted((str(r["doc_id"]), r["n_removed"]) for r in rlz_dedup.remove_repeats(same).collect())
    assert out == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]


def test_suffix(docs):
    got, seen = by_id(suffix_dedup.remove_repeated_bytes(docs)), set()
    for j, t in enumerate(TEXTS):
        b = (t or "").encode()
        grams = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = bytearray(len(b))
        for i, g in enumerate(grams):
            if g in seen:
                gone[i : i + 50] = b"\1" * 50
        seen |= set(grams)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert tuple(got[j])[1:] == (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()), j


def test_maximal_repeats():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(18)).encode() for _ in range(3)]
    places = collections.defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for e in range(i + 3, len(t) + 1):
                places[t[i:e]].add((k, i))

    def sides(g, at):
        left = {texts[k][i - 1] if i else (-1, k) for k, i in at}
        right = {texts[k][i + len(g)] if i + len(g) < len(texts[k]) else (-1, k) for k, i in at}
        return len(left) > 1 and len(right) > 1

    want = {g: sorted(at) for g, at in places.items() if len(at) > 1 and sides(g, at)}
    assert dict(suffix_dedup.maximal_repeats(texts, 3)) == want


def test_transducer_equals_library(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=wfst_tokenizer.MODEL_FILE)
    encoded = wfst_tokenizer.encode_documents(docs)
    got = by_id(encoded)
    odd = ["  a  b   c", "▁x ▁▁", "tab\tnew\n\nline", "日本語 😀 \x00", "    " * 9, "aaaaaaaaaaaaaaaaaaaaaaa"]
    machine = wfst_tokenizer.Transducer(wfst_tokenizer.Model())
    ids, starts = machine.encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == library.encode(odd)
    for j, t in enumerate(TEXTS):
        assert got[j]["ids"] == library.encode(t or "") and got[j]["n_tokens"] == len(got[j]["ids"])
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in wfst_tokenizer.decode_documents(encoded).collect())


def test_ctw_against_plain_trees(docs):
    got, depth = by_id(ctw_scoring.score_documents(docs)), ctw_scoring.DEPTH
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(t or "").translate(lower) for t in TEXTS]
    train = [t for j, t in enumerate(texts) if zlib.crc32(str(j).encode()) % 10]
    counts = collections.Counter(w for t in train for w in [*WORD.findall(t), None])
    n, v = sum(counts.values()), len(counts)
    nodes = collections.defaultdict(lambda: [0, 0])
    path = lambda t, i: (b"\0" * depth + t[max(0, i - depth) : i])[-depth:]
    for t in map(str.encode, train):
        for i, byte in enumerate(t):
            for d in range(depth + 1):
                for k in range(8):
                    nodes[path(t, i)[depth - d :], (byte >> (8 - k)) | (1 << k)][(byte >> (7 - k)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    below, stop = collections.defaultdict(float), {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(*nodes[key])
        stop[key] = 1.0 if len(key[0]) == depth else 1 / (1 + math.exp(max(-700, min(700, below[key] - own))))
        weighted = own if len(key[0]) == depth else np.logaddexp(own, below[key]) - math.log(2)
        if key[0]:
            below[key[0][1:], key[1]] += weighted
    for j, text in enumerate(texts):
        tokens = [*WORD.findall(text), None]
        assert got[j]["n_tokens"] == len(tokens) and got[j]["train_tokens"] == n and got[j]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert got[j]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        total, t = 0.0, text.encode()
        for i, byte in enumerate(t[:400]):
            for k in range(8):
                p, weight, q = 0.0, 1.0, 0.5
                for d in range(depth + 1):
                    key = (path(t, i)[depth - d :], (byte >> (8 - k)) | (1 << k))
                    if key not in nodes:
                        break
                    q = (nodes[key][1] + 0.5) / (sum(nodes[key]) + 1)
                    p += weight * stop[key] * q
                    weight *= 1 - stop[key]
                p += weight * q
                total += math.log10(p if (byte >> (7 - k)) & 1 else 1 - p)
        if len(t) <= 400:
            assert got[j]["score"] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_order_minhash(docs):
    got = by_id(order_minhash.near_duplicates(docs))
    assert [got[j]["class_id"] for j in range(len(TEXTS))] == classes_of(TEXTS)
    assert got[len(TEXTS) - 1]["class_id"] == 25 and not got[len(TEXTS) - 1]["kept"]
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {j for j, r in got.items() if r["kept"]}


def classes_of(texts, least=0.8):
    """Class of every text by comparing all pairs."""
    hashes = [order_minhash._hashes(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(hashes[i]) and (WORD.findall(texts[i] or "") == WORD.findall(texts[j] or "") or order_minhash.similar(hashes[i], hashes[j], least)):
                a, b = rp_forest._root(parent, i), rp_forest._root(parent, j)
                parent[max(a, b)] = min(a, b)
    return [rp_forest._root(parent, j) for j in range(len(texts))]


def test_order_minhash_short(spark):
    """Texts of 5 to 16 words and their edits at the ends and inside, against brute force."""
    rng = random.Random(8)
    texts = []
    for j in range(150):
        base = [f"w{j}x{i}" if rng.random() < 0.9 else "same" for i in range(8 if j < 30 else rng.randint(5, 14))]
        edits = [[*base, "new"], ["new", *base], [*base[:-1], "new"], ["new", *base, "end"], [*base[:3], "new", *base[3:]]]
        texts += [" ".join(base), " ".join(edits[j % 2] if j < 30 else rng.choice(edits))]
    got = by_id(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[j]["class_id"] for j in range(len(texts))] == classes_of(texts)
    assert sum(not got[j]["kept"] for j in range(60)) == 30


def test_order_minhash_scattered_edits(spark, monkeypatch):
    """Copies with edits all over, down to an alignment of 0.83, in large groups cut into small tiles."""
    monkeypatch.setattr(order_minhash, "TILE", 16)
    rng = random.Random(4)
    words = [f"v{j}" for j in range(900)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(100, 300))]
        base[20:20] = passage
        texts.append(" ".join(base))
        for share in (0.02, 0.06, 0.1, 0.14):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    texts += [" ".join(rng.choice(words) for _ in range(50)) + " " + " ".join(passage) for _ in range(80)]
    rng.shuffle(texts)
    got = by_id(order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = classes_of(texts)
    wrong = sum(got[j]["class_id"] != want[j] for j in range(len(texts)))
    assert len(set(want)) < 130 and wrong <= len(texts) // 50
    moved = " ".join(" ".join(texts[0].split()[i:] + texts[0].split()[:i]) for i in [70])
    assert not order_minhash.similar(order_minhash._hashes(texts[0]), order_minhash._hashes(moved), 0.8)  # same shingles, other order


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 4) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        most = rng.randint(0, 12)
        assert order_minhash.edit_distance_within(np.array(a), np.array(b), most) == (row[-1] if row[-1] <= most else None)


def test_mixing(docs):
    rows = mixing.mix_sources(docs, block=16).collect()
    size = {j: len(WORD.findall(t or "")) for j, t in enumerate(TEXTS)}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = collections.Counter()
    for j, s in source.items():
        sizes[s] += size[j]
    names = ["a", "b", "ü", None]
    weight = dict(zip(names, (3, 1, 2, 3), strict=True))
    pool, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = pool / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            pool -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(docs, block=16).collect())
    assert copies == {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in rows if r["size"] and r["taken"] * 2 >= r["size"]}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5), block=16).collect()))


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 3000), (1, 1000)], "ordinal int, taking long")
    slots = [r["ordinal"] for r in mixing.slot_schedule(targets, 10).orderBy("slot").collect()]
    assert collections.Counter(slots) == {0: 300, 1: 100}
    assert all(15 <= sum(slots[i : i + 100]) <= 35 for i in range(0, 400, 100))
    ranks = mixing.slot_schedule(targets, 10).orderBy("slot").where("ordinal = 1").collect()
    assert [r["rank"] for r in ranks] == list(range(100))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((30, 16))
    rows = [(j, (centers[j % 30] + 0.12 * rng.standard_normal(16)).tolist(), j % 30 % 3) for j in range(240)]
    rows += [(240, rows[0][1], 0), (241, rows[0][1], None), (242, None, 0), (243, [0.0] * 16, 0), (244, [float("nan")] * 16, 0), (245, [None] + [1.0] * 15, 0), (246, [1.0, 2.0], 0), (247, [2.0, 4.0], 0), (248, [], 0)]
    got = {r["vec_id"]: r for r in rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf_rows=40).collect()}
    usable = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.Counter()
    parent = list(range(249))
    total = 0
    for a in range(len(usable)):
        for b in range(a):
            (i, x, p), (j, y, q) = usable[a], usable[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                total += 2
                u, v = rp_forest._root(parent, i), rp_forest._root(parent, j)
                parent[max(u, v)] = min(u, v)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * total and all(r["n_links"] <= links[i] for i, r in got.items())
    assert got[240]["component_id"] == 0 and got[247]["component_id"] == 246 and got[241]["n_links"] == got[242]["n_links"] == got[245]["n_links"] == 0


def test_deep_forest_recall(spark):
    """Eight levels and more over 64 dimensions: recall of links against brute force."""
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((700, 64))
    x = centers[rng.integers(0, 700, 2500)] + 0.2 * rng.standard_normal((2500, 64))
    got = {r["vec_id"]: r["n_links"] for r in rp_forest.near_vectors(spark.createDataFrame([(j, v.tolist(), 0) for j, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), leaf_rows=24).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert links.sum() > 1000 and sum(got.values()) >= 0.97 * links.sum() and all(got[j] <= links[j] for j in range(2500))


def test_licenses(docs):
    got = by_id(license_scan.scan_licenses(docs))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for j, t in enumerate(TEXTS):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, name) for phrase, name in license_scan.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[j]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)) and r["base_labels"] == ",".join(sorted({n for _, n in at}))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r["score"] <= 1
    assert got[4]["labels"] == "cc-by,cc-by-nc-4.0" and got[4]["n_base"] == 2


def _notices(text, templates):
    """Labels and score by a look at every place of every template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    labels, score = set(), 0.0
    for label, notice, phrase in templates:
        words, key = notice.split(), phrase.split()
        before = next(b for b in range(len(words)) if words[b : b + len(key)] == key)
        for i in range(len(w)):
            if w[i : i + len(key)] == key:
                labels.add(label)
                score = max(score, sum(0 <= i - before + o < len(w) and w[i - before + o] == x for o, x in enumerate(words)) / len(words))
    base = {label for phrase, label in license_scan.BASE if f" {phrase} " in f" {' '.join(w)} "}
    return base, labels, score


def test_several_licenses(spark):
    """Documents with several notices, against a look at every place of every template."""
    rng = random.Random(6)
    notices = [notice for _, notice, _ in license_scan.TEMPLATES]
    texts = ["Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License version 3.", "general gnu public mozilla 4 nc, released under the MIT license"]
    texts += ["Released under the MIT license. Licensed under CC BY 4 0", " . ".join(notices), "license " * 20_000 + notices[10]]
    for _ in range(120):
        parts = rng.sample(notices, rng.randint(0, 4)) + [" ".join(rng.choice(rng.choice(notices).split()) for _ in range(rng.randint(0, 6))) for _ in range(2)]
        rng.shuffle(parts)
        texts.append(" some words ".join(parts))
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for j, t in enumerate(texts):
        base, labels, score = _notices(t, license_scan.TEMPLATES)
        assert got[j]["labels"] == ",".join(sorted(base | labels)) and got[j]["score"] == pytest.approx(score or (0.5 if base else 0.0)), t[:200]
    assert got[3]["labels"].count(",") >= 14


def test_own_templates(spark):
    """Templates without any of the usual words, and more words than a long has bits."""
    own = [("u", "this is free and unencumbered software", "free and unencumbered"), ("long", " ".join(f"t{j}" for j in range(200)), "t50 t51 t52"), ("twice", "ab ab ab cd", "ab ab cd")]
    texts = ["This is free and unencumbered software!", "t50 t51 t52", " ".join(f"t{j}" for j in range(200)), "ab ab ab ab cd", "cd ab ab", "free unencumbered and", None, ""]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own))
    for j, t in enumerate(texts):
        _, labels, score = _notices(t or "", own)
        assert (got[j]["labels"], got[j]["score"]) == (",".join(sorted(labels)), pytest.approx(score))
    assert [got[j]["labels"] for j in range(5)] == ["u", "long", "long", "twice", ""]


def test_shards(docs):
    rows = sharding.shard_by_bytes(docs, 5).collect()
    total = collections.Counter()
    for r in rows:
        data = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
    assert len(rows) == len(TEXTS) and max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in rows)
    for shard in total:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in rows)


def test_components(spark):
    links = spark.createDataFrame([(j, j + 1) for j in range(40)] + [(100, 101), (101, 100), (100, 101)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert {got[j] for j in range(41)} == {0} and got[100] == got[101] == 100


def _mixed(docs):
    """How often each (row, source, words) stands, by the closed form of the mix."""
    sizes = collections.Counter()
    for _, source, words, _ in docs:
        sizes[source] += len(words)
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[j % 3] for j, s in enumerate(names)}
    pool, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = pool / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2.0 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        pool -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    times = {}
    for s in names:
        at, taking = 0, math.floor(target[s] + 0.5)
        for doc_id, _, words, _ in sorted((d for d in docs if d[1] == s), key=lambda d: hashlib.md5(f"mix|{d[0]}".encode()).hexdigest()):
            taken = sum(max(0, min(at + lap * sizes[s] + len(words), taking) - at - lap * sizes[s]) for lap in (0, 1))
            times[doc_id] = math.floor(taken / len(words) + 0.5) if words else 0
            at += len(words)
    return times


def test_pipeline_by_brute_force(spark, docs, labels, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    import corpus_pipeline

    docs.drop("words").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    judged, source = by_id(quality_rules.judge_quality(docs, labels)), {r["doc_id"]: r["source"] for r in docs.collect()}
    kept = [j for j in range(len(TEXTS)) if judged[j]["kept"]]
    classes = classes_of([TEXTS[j] for j in kept])
    stage, seen = [], set()
    for j in [kept[k] for k in range(len(kept)) if classes[k] == k]:
        w, gone = WORD.findall(TEXTS[j]), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if g in seen else set()
            seen.add(g)
        left = [x for i, x in enumerate(w) if i not in gone]
        if left:
            stage.append((j, source[j], left, " ".join(left) if gone else TEXTS[j]))
    library = sentencepiece.SentencePieceProcessor(model_file=wfst_tokenizer.MODEL_FILE)
    times, want = _mixed(stage), []
    for j, _, _, text in stage:
        want += [(j, tuple(library.encode(text)))] * times[j]
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in out) == sorted(want) and all(r["n_tokens"] == len(r["ids"]) for r in out) and out


def test_pipeline_on_empty_tables_and_odd_ids(spark, docs, labels, tmp_path):
    import corpus_pipeline

    plain = docs.drop("words").withColumn("n_chars", F.length("text").cast("long"))
    long_text = " ".join(f"w{j * 7919 % 20011}" for j in range(20_000))
    odd = spark.createDataFrame([(None, long_text, "en", None, 0), (None, "a b c d e f g h i j k l m n", None, "a", 0), (7, "q r s t u v w x y z aa bb cc", "en", "a", 0), (7, "q2 r2 s2 t2 u2 v2 w2 x2 y2 z2 aa2", "en", "a", 0)], plain.schema)
    for name, table in (("none", plain.limit(0)), ("odd", plain.unionByName(odd).unionByName(odd))):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        ids = collections.Counter(r["doc_id"] for r in out.collect())
        assert (sum(ids.values()) == 0) if name == "none" else (ids[None] >= 2 and ids[7] >= 1)
