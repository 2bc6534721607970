import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbeck.llm import chat as C
from tests.llm.data import BPE

PART = st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "a", "/s>", "|x|>", "INST]", " "])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PART, max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control(text):
    out = C.escape(text)
    assert C.unescape(out) == text
    assert not any(c in out for c in ["</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<<SYS>>"])


def test_awkward_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "c </s>"), (1, 2, "assistant", "c </s>"), (2, None, None, "x"), (2, 0, "tool <|end|>", ""), (None, 0, "assistant", ""), (3, 0, "user", "y " * 5000)]
    rows += [(4, k, "assistant", f"t{k}") for k in range(C.PIECE * 2 + 3)]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, ids string, piece int")
    out = {r.conv_id: r for r in C.digests(C.formatted(df, BPE), BPE).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    for conv, r in out.items():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.digests(C.formatted(df.limit(0), BPE), BPE).count() == 0


def test_planted_conversation(spark):
    df = spark.createDataFrame([(-1, 0, "user", C.PLANTED), (-1, 1, "assistant", C.PLANTED)], "conv_id long, turn long, role string, text string")
    r = C.digests(C.formatted(df, BPE), BPE).first()
    assert (r.n_turns, r.loss_chars) == (2, len(C.PLANTED))
    shown = [C.RESERVED[C.TURN], C.RESERVED[C.USER], C.RESERVED[C.END], C.RESERVED[C.TURN], C.RESERVED[C.ASSISTANT], C.RESERVED[C.END]]
    assert r.formatted_chars == sum(map(len, shown)) + 2 * len(C.escape(C.PLANTED))
