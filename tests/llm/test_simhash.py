import numpy as np
import pytest
import xxhash

from tarnbeck.llm import simhash as S
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import awkward, empty
from tests.oracle import SF


def plain_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: list[int], most: int = 3) -> list[int]:
    """The least index of each fingerprint's component."""
    out = list(range(len(fps)))

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                out[b] = a
    return [root(i) for i in range(len(fps))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "A b", "One two THREE four", "É é A\x0bB\x0cc  d e", "ÀÉ ÄÖ x y z"])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    roots = plain_components(fps)
    want = [(d.doc_id, f"{fp:016x}", docs[r].doc_id) for d, fp, r in zip(docs, fps, roots, strict=True)]
    assert [tuple(r) for r in QUERIES["op1_simhash_near_dedup"](spark, SF).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_are_complete_whatever_the_parts(spark, parts, monkeypatch):
    monkeypatch.setattr(S, "part_count", lambda *_: parts)
    rng = np.random.default_rng(parts)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():  # clusters around each seed, chains included, and a frequent half
        for _ in range(20):
            s ^= int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)))
            fps.add(s)
        fps.add((seeds.tolist()[0] & ~0xFFFFFFFF) | (s & 0xFFFFFFFF))
    fps = sorted(fps, key=signed)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    found = {r.node: r.root for r in S.components(S.links(df, len(fps))).collect()}
    roots = plain_components(fps)
    for x, r in zip(fps, roots, strict=True):
        assert found.get(signed(x), signed(x)) == signed(fps[r])


def test_thresholds_add_up():
    rng = np.random.default_rng(0)
    fps = rng.integers(-(1 << 63), 1 << 63, 500)
    groups = S.deal_bits(np.full((64, 64), 100.0), 500, 3)
    values = S.part_values(fps, groups)
    shares = {}
    for g, group in enumerate(groups):
        for a, w in S.blocks_of(len(group)):
            shares[g, a] = S.near_shares(np.bincount((values[g] >> a) & ((1 << w) - 1), minlength=1 << w), w, 3)
    assert (S.choose_thresholds(values, groups, shares, 500, 3).sum(1) == 3 - 3 + 1).all()
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_awkward_rows(spark):
    rows = S.near_duplicates(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert all(len(x) == 1 for x in by.values())
    assert by[0] == by[1] == by[2] == by[3] == {("0" * 16, 0)}
    assert {c for _, c in by[9]} == {c for _, c in by[10]} == {c for _, c in by[11]} == {9}
    assert S.near_duplicates(empty(spark)).count() == 0


def plain_shingles(text: str) -> set[bytes]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({b" ".join(words)} if words else set())


def plain_near(text: str) -> tuple[int, int]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    own = [xxhash.xxh64_intdigest(w, seed=42) for w in set(words)]
    upper = [xxhash.xxh64_intdigest(x, seed=42) >> 32 for x in plain_shingles(text)]
    sketch = 0
    for k in range(512 if upper else 0):
        rule = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=42)
        factor, summand = rule >> 32 | 1, rule & 0xFFFFFFFF
        least = min((x * factor + summand) & 0xFFFFFFFF for x in upper)
        sketch |= (least * 0x9E3779B1 >> 31 & 1) << k
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own)), sketch


def near_roots(texts: list[str]) -> list[int]:
    """Groups by links of similarity 0.8 or more, where the probes reach."""
    prints, sets = [plain_near(t) for t in texts], [plain_shingles(t) for t in texts]
    out = list(range(len(texts)))

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    for i, (a, x) in enumerate(prints):
        for j, (b, y) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= S.WORD_LIMIT and (x ^ y).bit_count() <= S.SHINGLE_LIMIT and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root(i) != root(j):
                lo, hi = sorted((root(i), root(j)))
                out[hi] = lo
    return [root(i) for i in range(len(texts))]


def test_keep_one_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = {docs[r].doc_id for r in near_roots([d.text for d in docs])}
    assert {r.doc_id for r in S.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect()} == want


def test_near_groups_hold_the_pairs_of_similar_texts(spark):
    """Recall of pairs whose five-word shingles have a Jaccard similarity of 0.8 or more, among made copies."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        words = rng.choice(vocabulary, rng.integers(60, 400)).tolist()
        copy = list(words)
        for _ in range(max(1, len(words) // 60)):
            copy[rng.integers(len(copy))] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keep = {r.doc_id: r.keep_id for r in S.near_groups(df).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    close = [k for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    assert len(close) > 30 and sum(keep[k] == keep[k + 1] == k for k in close) >= 0.9 * len(close)
    assert all(keep[k] // 2 == k // 2 for k in keep) and all(keep[k + 1] == k + 1 for k in range(0, len(texts), 2) if k not in close)


def chained(texts: dict[int, str], keep: dict[int, int]) -> bool:
    """Whether each group hangs together by links of similarity 0.8 or more, all pairs of it looked at."""
    groups = {}
    for k, root in keep.items():
        groups.setdefault(root, []).append(k)
    for own in groups.values():
        sets, left, todo = {k: plain_shingles(texts[k]) for k in own}, set(own[1:]), [own[0]]
        while todo:
            a = sets[todo.pop()]
            near = {k for k in left if 5 * len(a & sets[k]) >= 4 * len(a | sets[k])}
            left -= near
            todo += near
        if left:
            return False
    return True


def test_dense_groups_hang_together_by_verified_links(spark):
    """Families whose members lie on both sides of the limit: none goes without a partner, few partners are lost."""
    rng = np.random.default_rng(9)
    texts = {}
    for family in range(12):
        words = [f"f{family}w{k}" for k in range(rng.integers(80, 200))]
        for _ in range(25):
            own = list(words)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(len(own))] = f"x{rng.integers(10**6)}"
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    keep = {r.doc_id: r.keep_id for r in S.near_groups(df).collect()}
    assert chained(texts, keep)
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    near = [(a, b) for a in texts for b in range(a + 1, a - a % 25 + 25) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    far = sum(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a in texts for b in range(a + 1, a - a % 25 + 25))
    assert len(near) > 500 and far > 500 and sum(keep[a] == keep[b] for a, b in near) >= 0.97 * len(near)


def test_keep_one_of_awkward_rows(spark):
    kept = S.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({plain_near(t) for t in texts})
    assert {plain_near(t) for t in texts} == {plain_near(r.text) for r in awkward(spark).collect()}
    assert S.keep_one(empty(spark)).count() == 0


def test_keep_one_with_repeated_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(5, "one text", 1), (1, "One text", 2), (9, "quite another", 3), (9, "and one more", 4), (9, "and one more", 5), (None, "one text", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({c: F.lit("taken") for c in ("gone", "row", "node", "near0", "fp")})
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "One text"), (9, "and one more"), (9, "quite another")]


def test_sketch_tells_similarity():
    """The share of differing bits is half of what two sets don't have in common; long texts are sketched in pieces."""
    rng = np.random.default_rng(5)
    for similarity in (0.5, 0.7, 0.8, 0.9, 1.0):
        off = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            a, b = pool[: round(1000 * (1 + similarity) / 2)], pool[round(1000 * (1 - similarity) / 2) :]
            off.append((int.from_bytes(S.sketch(a), "big") ^ int.from_bytes(S.sketch(b), "big")).bit_count() / 512)
        assert abs(np.mean(off) - (1 - similarity) / 2) < 0.01
    assert S.sketch(np.empty(0, np.uint64)) == bytes(64)
