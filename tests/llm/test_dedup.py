"""Substring, suffix-array and near dedup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import compare, duck
from tidemark.llm import anchors, near_dedup, queries, substring_dedup, suffix_dedup
from tidemark.llm import kernels as K

SF = "/root/testdata/sf0.001"


def odd_docs(seed=1):
    """Copies, near copies, hot passages, runs of one word, other alphabets, white space of all kinds, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(45), words(260)
    out = [None, "", " \n\t ", "one", "x " * 90, "y\t\r\n\x0b\x0cy " * 60, " ".join(words(19)), " ".join(passage)]
    for i in range(14):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n", "  "]).join(copy))
    for _ in range(20):
        out.append(" ".join(words(rng.randint(0, 80)) + passage[rng.randint(0, 20) :] + words(rng.randint(0, 80))))
    out += [" ".join(base), " ".join(base), "\xa0".join(words(50)), "z" * 1500, "z" * 900 + "q", "é" * 700]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i, "s") for i, t in odd_docs()], "doc_id int, text string, start int, n_removed string").repartition(3).cache()


def found(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("hot", [anchors.HOT, 2])
def test_substring(docs, hot):
    assert found(substring_dedup.substring_dedup(docs, hot=hot), "n_words", "n_removed", "kept_sha256") == brute.substring(odd_docs())


@pytest.mark.parametrize("hot", [anchors.HOT, 2])
def test_suffix(docs, hot):
    assert found(suffix_dedup.suffix_dedup(docs, hot=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(odd_docs())


@pytest.mark.parametrize("window", [3, 8, 21])
def test_other_windows(spark, window):
    rows = [(i, " ".join(random.Random(i).choice("ab") for _ in range(40))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring_dedup.substring_dedup(df, window=window), "n_words", "n_removed", "kept_sha256") == brute.substring(rows, window)
    assert found(suffix_dedup.suffix_dedup(df, window=window), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows, window)


def test_repeated_ids_and_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(10, 60))
    rows = [(1, a), (1, a), (1, b), (None, a), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(df).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed").collect())
    # the null id is the earliest; equal rows of one id are one document, the other text is another
    assert got == [(-1, 50, 0), (1, 50, 40), (1, 50, 50), (1, 50, 50), (2, 1, 0)]
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(df, window=20).select(F.coalesce("doc_id", F.lit(-1)), "n_removed").collect())
    assert [n for _, n in got][:1] == [len(a)] and len(got) == 5
    assert substring_dedup.without_repeats(df).count() == 5


def test_drop_tables(spark):
    from tidemark.llm import shared

    shared.drop_tables(spark)
    df = shared.cut(spark.range(5).toDF("x"), "mine")
    assert df.count() == 5
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}")
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(home)
    shared.drop_tables(spark)
    assert not fs.exists(home)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for f in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, suffix_dedup.without_repeats, near_dedup.near_dedup, substring_dedup.without_repeats, near_dedup.one_of_each):
        assert f(none).count() == 0


def test_substring_where_hashes_meet(monkeypatch):
    """A shard in which different windows have one hash gives the spans it gives without."""
    texts = [t for _, t in odd_docs() if t and len(brute.SPACED.findall(t)) >= 20]
    held = [(i, 0, 0, " ".join(brute.SPACED.findall(t)).encode()) for i, t in enumerate(texts)]

    def gone(spans):
        return {(d, p) for d, _, first, n in spans for p in range(first, first + n)}

    want = gone(substring_dedup.judge(held))
    real = K.window_hashes
    monkeypatch.setattr(K, "window_hashes", lambda h, n: real(h, n) % np.uint64(50))
    assert gone(substring_dedup.judge(held)) == want and len(want) > 100


def test_shared_folder_is_asked_for():
    """Without a shared folder only a local master may use a temporary one."""
    from types import SimpleNamespace as S

    from tidemark.llm import shared

    def session(master):
        unset = S(get=lambda *_: None)
        return S(conf=unset, sparkContext=S(getConf=lambda: unset, master=master, applicationId="test-shared-folder"))

    assert shared.shared_dir(session("local[4]")).startswith("file:///")
    for master in ("spark://somewhere:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master))


def test_without_repeats(docs):
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    want = brute.substring(odd_docs())
    for i, t in odd_docs():
        assert brute.sha(" ".join(brute.SPACED.findall(kept[i] or "")).encode()) == want[i][2]
        if not want[i][1]:
            assert kept[i] == t
    assert substring_dedup.without_repeats(docs).columns == docs.columns


def test_bytes_that_are_left(docs):
    want = brute.suffix(odd_docs())
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "kept"]
    rows = out.collect()
    assert len(rows) == len(want) and all(brute.sha(bytes(r.kept)) == want[r.doc_id][3] for r in rows)


def test_substring_oracle(spark):
    assert compare(queries.QUERIES["op2_substring_dedup"](spark, SF), duck(SF), queries.ORACLE_SQL["op2_substring_dedup"]) == 200


def test_suffix_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op4_suffix_dedup"](spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)


def test_suffix_on_more_documents(spark):
    """Every document of sf0.01 against a plain count of all 400-byte strings (by digests of 16 bytes)."""
    import hashlib
    from collections import Counter

    sf, n = "/root/testdata/sf0.01", 400
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    at = {k: [hashlib.blake2b(t[i : i + n], digest_size=16).digest() for i in range(len(t) - n + 1)] for k, t in texts.items()}
    count = Counter(x for v in at.values() for x in v)
    got = found(queries.QUERIES["op4_suffix_dedup"](spark, sf), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert len(got) == len(texts) == 1000
    hit = 0
    for k, t in texts.items():
        gone = np.zeros(len(t) + 1, int)
        for i, x in enumerate(at[k]):
            if count[x] > 1:
                gone[i] += 1
                gone[min(len(t), i + n)] -= 1
        gone = np.cumsum(gone[: len(t)]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        assert got[k] == (len(t), int(gone.sum()), spans, brute.sha(kept)), k
        hit += bool(gone.any())
    assert hit > 200


def test_bucket_pointers_without_hashes():
    rng = np.random.RandomState(2)
    data = rng.randint(97, 99, 3000).astype(np.uint8)
    off = np.array([0, 900, 900, 2000, 3000])
    raw = data.tobytes()
    for window in (5, 8, 13, 16, 40):
        at = [i for a, b in zip(off, off[1:]) for i in range(a, b - window + 1)]
        count = {}
        for i in at:
            count[raw[i : i + window]] = count.get(raw[i : i + window], 0) + 1
        want = [i for i in at if count[raw[i : i + window]] > 1]
        for exact in (False, True):
            assert suffix_dedup.repeated(data, off, window, exact).tolist() == want


def test_segments_cover_every_window_once():
    texts = [("a b " * 60).encode(), b"", " ".join(f"w{i % 7}" for i in range(100)).encode()]
    off = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for shape in (anchors.Shape(20, 6, True), anchors.Shape(64, 16, False)):
        b = anchors.symbols(data, off, shape)
        s = anchors.segments(b, shape)
        got = sorted(i for f, l in zip(s.first, s.last) for i in range(f, l + 1))
        assert got == [i for i in range(len(b.starts) - shape.window + 1) if b.doc[i] == b.doc[i + shape.window - 1]]
        assert ((s.first <= s.place) & (s.place <= s.first + shape.window)).all()


def test_sliding():
    h = np.random.RandomState(0).randint(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 16, 17, 200, 201):
        assert K.sliding(h, w).tolist() == [h[i : i + w].min() for i in range(len(h) - w + 1)]
        assert K.sliding(h, w, False).tolist() == [h[i : i + w].max() for i in range(len(h) - w + 1)]


# near-duplicates


def test_near_classes(docs):
    want = brute.classes(odd_docs())
    got = found(near_dedup.near_dedup(docs), "class_id")
    assert {k: v[0] for k, v in got.items()} == want
    stays = {r.doc_id for r in near_dedup.one_of_each(docs).collect()}
    assert stays == {k for k, v in want.items() if k == v}
    assert near_dedup.one_of_each(docs).columns == docs.columns


def test_near_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = found(queries.QUERIES["op9_near_dedup"](spark, SF), "class_id")
    assert {k: v[0] for k, v in got.items()} == brute.classes(rows)


def test_near_on_more_documents(spark):
    """All classes of sf0.01 against all pairs that share a shingle, aligned by brute force."""
    from collections import defaultdict

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    s = [brute.shingles(t) for _, t in rows]
    holders, common = defaultdict(list), defaultdict(int)
    for i, g in enumerate(s):
        for x in g:
            for j in holders[x]:
                common[j, i] += 1
            holders[x].append(i)
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for (j, i), m in common.items():
        if m / (len(s[i]) + len(s[j]) - m) >= 0.8 - 1e-9 and (s[i] == s[j] or brute.aligned(s[i], s[j]) >= 0.8 - 1e-9):
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
            links += 1
    assert links > 90
    got = found(queries.QUERIES["op9_near_dedup"](spark, sf), "class_id")
    assert {k: v[0] for k, v in got.items()} == {k: find(k) for k, _ in rows}


def test_chain_of_copies(spark):
    """Neighbours are linked, ends are not: all are one class."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(f"e{j}" if j < 3 * i else w for j, w in enumerate(base))))
    assert brute.aligned(brute.shingles(rows[0][1]), brute.shingles(rows[11][1])) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(found(near_dedup.near_dedup(df), "class_id").values()) == {(0,)} and set(brute.classes(rows).values()) == {0}


def test_copies_too_far_from_each_other(spark):
    """A star whose ends link only to the middle, which does not come first; and a group of copies none of which are links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]

    def copy(n):
        out = list(base)
        for j in rng.sample(range(5, 295), n):
            out[j] = f"x{rng.random()}"
        return " ".join(out)

    rows = [(i, copy(5)) for i in range(10)] + [(10, " ".join(base))] + [(20 + i, copy(14)) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {k: v[0] for k, v in found(near_dedup.near_dedup(df), "class_id").items()} == brute.classes(rows)


def test_bucket_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 6000)
    test_copies_too_far_from_each_other(spark)


def test_null_ids_and_repeated_rows(spark):
    """Rows without an id are documents by their text; they don't name a class."""
    alone = "p q r s t u v"
    rows = [(None, "a b c d e f"), (None, None), (None, None), (None, alone), (None, alone), (None, "P q r s t u v"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A, b c d e f!"), (5, ""), (6, ""), ((1 << 62) + 5, "x y z " * 9), (None, "x y z " * 9)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, id string")
    got = sorted((tuple(r) for r in near_dedup.near_dedup(df).collect()), key=str)
    big = (1 << 62) + 5
    assert got == sorted([(None, 3), *[(None, None)] * 5, (3, 3), (3, 3), (4, 3), (5, 5), (6, 6), (big, big), (None, big)], key=str)
    left = near_dedup.one_of_each(df)
    assert left.columns == df.columns
    stays = sorted(((r.doc_id, (r.text or "").lower()) for r in left.collect()), key=str)
    assert stays == sorted([(None, ""), (None, ""), (None, alone), (3, "a b c d e f"), (3, "a b c d e f"), (5, ""), (6, ""), (big, "x y z " * 9)], key=str)


def test_short_texts_meet(spark):
    """Texts of 8 to 40 words, each with a copy that is linked at just about 0.8: none is missed."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        n = rng.randint(8, 40)
        w = [f"{rng.randrange(10**6)}" for _ in range(n)]
        k = n - 4  # k-mers
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"x{j}" for j in range(k // 4)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {k: v[0] for k, v in found(near_dedup.near_dedup(df), "class_id").items()}
    assert got == {i: i // 2 * 2 for i in range(1200)}


def test_second_text_of_a_copy(spark):
    """An id with a copy of a smaller id's text and a text of its own, of which another has a near copy."""
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (9, two + " more")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (5, 1), (9, 1)}


def test_alignment():
    rng = np.random.RandomState(1)
    for _ in range(200):
        a = rng.permutation(40)[: rng.randint(20, 40)].astype(np.uint64)
        b = a.copy()
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(len(b))] = rng.randint(1000, 10**6)
        if rng.rand() < 0.3:
            b = np.roll(b, 1)
        want = brute.aligned(a.tolist(), b.tolist())
        got = near_dedup.aligned(a, b)
        assert (abs(got - want) < 1e-9) if want >= 0.8 else got < 0.8


def test_components(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 120)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
