"""The queries themselves, over a whole small table, against plain versions of their results."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnbeck.llm import chat as C
from tarnbeck.llm import quality as Q
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import BPE
from tests.llm.test_quality import Plain, plain_counts
from tests.oracle import SF


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_chat_query(spark):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in rows_of(spark, "conversations")]
    turns += [(-1, k, role, C.PLANTED) for k, role in enumerate(("user", "assistant"))]
    want = {}
    for i, _, role, text in sorted(turns):
        n, all_, loss = want.get(i, (0, "", ""))
        want[i] = (n + 1, all_ + f"{role}\n{text}\n", loss + text * (role == "assistant"))
    got = QUERIES["op3_chat_formatting"](spark, SF).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {(i, n, sha(a), len(x), sha(x)) for i, (n, a, x) in want.items()}
    assert len(got) == len(want) and all(r.formatted_chars > len(want[r.conv_id][2]) for r in got)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(BPE))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows_of(spark, "documents")}
    pieces, sequences = {}, {}
    for r in QUERIES["op6_packing"](spark, SF).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in [*((len(ids[i]), p) for i, p in pieces.items()), *((None, p) for p in sequences.values())]:
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == i if i is not None else at <= 2048


def test_sharding_query(spark):
    text = {r.doc_id: (r.text or "").encode() for r in rows_of(spark, "documents")}
    rows = QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    loads, slots = Counter(), {}
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 8


class Quick(Plain):
    """The same model with each context's n-grams gathered once."""

    def __init__(self, texts):
        super().__init__(texts)
        self.after = [{} for _ in range(5)]
        for n in range(1, 5):
            for g, v in self.counts[n].items():
                self.after[n].setdefault(g[:-1], {})[g] = v

    def p(self, gram):
        n, d = len(gram), self.d[len(gram)]
        own = self.after[n].get(gram[:-1], {})
        lower = 1 / (len(self.counts[1]) + 1) if n == 1 else self.p(gram[1:])
        if not own:
            return lower
        less = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        return (own[gram] - less(own[gram]) if gram in own else 0) / total + sum(map(less, own.values())) / total * lower


def test_quality_query(spark):
    docs = rows_of(spark, "documents")
    low = {r.doc_id: "".join(chr(ord(c) & 0xFFFF) for c in r.text or "") for r in docs}
    fold = {r.doc_id: zlib.crc32((r.text or "").encode()) % 2 for r in docs}
    models = [Quick([low[i] for i in low if fold[i] != k]) for k in range(2)]
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    for i in sorted(low)[::10]:
        if low[i]:
            assert math.log(rows[i].perplexity) == pytest.approx(models[fold[i]].cost(low[i]), rel=1e-4)

    def band(costs):
        q = [sorted(costs)[math.ceil(p * len(costs)) - 1] for p in (0.25, 0.5, 0.75)]
        return q[1], max((q[2] - q[0]) / 1.349, Q.SPREAD)

    passed, langs = [], {}
    for r in docs:
        n, *_, repeated = plain_counts(r.text or "")
        if n >= 20 and 100 * repeated <= 30 * n:
            passed.append(r.doc_id)
            langs.setdefault(r.lang or "", []).append(math.log(rows[r.doc_id].perplexity))
    pooled = band([c for x in langs.values() for c in x])
    for r in docs:
        mid, spread = band(langs[r.lang or ""]) if len(langs.get(r.lang or "", ())) >= Q.LEAST_DOCS else pooled
        wide = spread + Q.SHORT / math.sqrt(max(len(r.text or ""), 1))
        cost = math.log(rows[r.doc_id].perplexity) if rows[r.doc_id].perplexity is not None else mid
        edge = min(abs(cost - mid + Q.LOWER * wide), abs(cost - mid - Q.UPPER * wide))
        if edge > 1e-9:
            assert rows[r.doc_id].kept == (r.doc_id in passed and -Q.LOWER * wide <= cost - mid <= Q.UPPER * wide)
