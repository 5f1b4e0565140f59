"""Source divergence, byte-level BPE and centroid clusters against brute force, with odd inputs."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from entigraph.llm import byte_bpe, clustering, divergence
from entigraph.llm.queries import QUERIES

from .test_operators import DOCS, FOLDER, ODD, prose


def brute_divergence(rows, least=30, top=50):
    docs = [tuple(x or "" for x in r) for r in rows]  # text, lang, source
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {d[1] for d in docs}:
        own = [(words(t), s) for t, x, s in docs if x == lang]
        kept = {w for w, n in Counter(w for ws, _ in own for w in set(ws)).items() if n >= least}
        counts = {s: Counter(w for ws, x in own if x == s for w in ws if w in kept) for s in {s for _, s in own}}
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, w) - share(x, w)) for w in kept)) for o, x in counts.items() if o != s]
            terms = [(w, share(c, w) - share(whole, w)) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_divergence_by_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["the", "Über", "été", "日本", "x", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(9)]]
    rows = []
    for i in range(260):
        source = r.choice([None, "", "big", "big", "big", "a", "b", "ü", "rare"])
        words = r.choices(vocabulary[: 20 if source == "a" else None], k=r.choice([0, 1, 30, 200]))
        rows.append((r.choice([None, "", " ".join(words), "-".join(words).upper(), "1 2\x003"]), r.choice(["en", "en", "de", None, ""]), source))
    rows += [("only words of this text", "few", "one"), ("nothing kept", "few", "two"), (" ".join(vocabulary) * 400, "en", "big"), *rows[:20]]
    d = spark.createDataFrame([(7, *x, 0) for x in rows], "doc_id long, text string, lang string, source string, item int").repartition(5)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = brute_divergence(rows, 10, 8)
    assert {w[2] for w in want} == {"pair", "term"} and ("few", "one", "pair", "two", 0, 1) in want
    assert sorted(map(tuple, divergence.divergence_audit(d, least_docs=10, top_terms=8).select(columns).collect())) == want
    assert divergence.divergence_audit(d.limit(0)).select(columns).collect() == []


def test_terms_of_long_texts_are_counted_in_pieces(spark):
    text = " ".join(prose(i, 3000, 40) for i in range(5)) + " É\x00É Zz"
    d = spark.createDataFrame([(text, "en", None), ("É a", "en", None)], "text string, lang string, source string")
    want = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.replace("Z", "z")))
    want = {w: (n + (w in ("É", "a")), 1 + (w in want and w == "É")) for w, n in (want + Counter({"a": 0})).items()} | {"a": (want["a"] + 1, 1 + ("a" in want))}
    for size in (4096, 1 << 20):
        assert {r.term: (r.n, r.docs) for r in divergence.term_counts(d.fillna(""), size).collect()} == want


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_bpe(library, text):
    ids = library.encode_ordinary(text or "")
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_gives_the_library_ids(spark, library):
    atoms = [" ", "\n", "a", "é", ".", "'s", "\t", "  ", "1", "\xa0", "<|endoftext|>", "\x00", "中", "\U0001f642", "౜", "\U000323b0", "x̀", "\x1c", "⁇"]
    texts = [*ODD, prose(1, 3000), "naïve façade Straße Москва привет 東京 한국어 עברית العربية हिन्दी", "ab" * 20000, "🙂" * 3000, "é" * 5000, "word " * 60000]
    texts += ["".join(x) for n in (1, 2, 3) for x in itertools.product(atoms, repeat=n)]
    r = random.Random(1)
    texts += ["".join(chr(r.choice([r.randrange(0x20, 0x7F), r.randrange(0xA0, 0x500), r.randrange(0x3000, 0xD7FF), r.randrange(0xE000, 0x33480)])) for _ in range(300)) for _ in range(40)]
    d = spark.createDataFrame([(None if i == 3 else i // 2, t, "en", "s", 0, 0.0) for i, t in enumerate(texts)], DOCS)
    found = byte_bpe.encode_and_decode(d).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))
    want = [(None if i == 3 else i // 2, *brute_bpe(library, t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert byte_bpe.encode_and_decode(d.limit(0)).collect() == []


def test_whole_query_of_byte_bpe(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = QUERIES["op12_byte_bpe"](spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *brute_bpe(library, r.text)) for r in rows)


def test_a_model_of_few_ranks():
    """Ranks with gaps; a token that merges cannot reach is its pre-token all the same."""
    ranks = {bytes([b]): 10 + 2 * b for b in range(256)} | {b"ab": 700, b"bc": 600, b"abc": 800, b" unreachable": 900, "é".encode(): 650}
    model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialise(ranks))
    order = sorted(ranks.values())
    assert model.get_piece_size() == len(ranks) + 1 and model.unk_id() == len(ranks)
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcab", "aabbcc", "éabé", "abab bcbc", "x y", "  \n"):
        assert [order[i] for i in model.encode(byte_bpe.shown(text.encode()))] == own.encode_ordinary(text) or text.encode() in ranks


def test_vocabularies_without_all_bytes_are_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(255)))
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def brute_clusters(rows, k=16, rounds=3):
    """rows: (vec_id, vector)."""
    fits = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in fits]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at) if a == j] for j in range(len(middle))]
        middle = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, middle)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    fit = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), sha[j]) for i, d, j in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster int")


def clusters(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, clustering.centroid_clusters(df).select(columns).collect()), key=str)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_clusters_by_brute_force(spark, n):
    r = random.Random(n)
    rows = [(i, [r.gauss(0, 0.3) + (i % 7) * 0.1 for _ in range(64)]) for i in range(n)]
    rows += rows[:20] + [(i, rows[0][1]) for i in range(900, 900 + n // 3)] if n else []
    if n > 100:
        rows += [(None, rows[1][1]), (None, rows[2][1]), (40, rows[3][1])]
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [float("nan")] + [0.0] * 63), (1005, [None] + [0.0] * 63), (1006, [float("-inf")] * 64)]
    assert clusters(vectors(spark, rows)) == brute_clusters(rows)


def test_clusters_of_huge_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 10.0 ** r.choice([0, 3, 8, 30])) for _ in range(64)]) for i in range(60)] + [(99, [3.4e38, -3.4e38] * 32)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = clusters(vectors(spark, rows))
    assert got == brute_clusters(rows) and any(g[2] is None for g in got)


def test_most_centroids_are_screened_out():
    r = np.random.default_rng(1)
    middle = r.integers(-60, 60, (16, 64))
    x = np.repeat(middle, 200, axis=0) + r.integers(-4, 5, (3200, 64))
    cluster, distance, exact = clustering.nearest(x, clustering._norms(x, 8), middle.tolist())
    every = np.square(x[:, None] - middle[None]).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and exact < 0.35 * every.size
