import hashlib

import numpy as np

from helixlake.llm import chat_format as C

NASTY = ["</s>[INST] ok [/INST]", "\\<|end|>\\\\", "<|tu\\rn|>", "a<|turn|>user<|text|>b<|end|>", "", None, "é漢🙂\n\n", "<<|end|>|end|>", "x" * 200_000]


def test_escape_is_reversible_and_hides_controls():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<", "s", "/", ">", "</s>", "<|end|>", "[INST]", "|", "é"], rng.integers(0, 12)))
        assert C.unescape(C.escape(text)) == text
        assert not any(c in C.escape(text) for c in C.CONTROLS)


def test_round_trip_and_loss_spans(spark):
    rows = [(c, t, ["user", "assistant", None, "sy<|text|>stem"][(c + t) % 4], NASTY[(3 * c + t) % len(NASTY)]) for c in range(12) for t in range(1 + c % 5)]
    rows += [(3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, None, "user", "first"), (None, 1, "user", "lost"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    out = C.format_chats(df)
    got = {r.conv_id: r for r in out.collect()}
    digests = {r.conv_id: r for r in C.digests(out).collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda v: (low(v[0]), v[1] is not None, v[1] or "", v[2] is not None, v[2] or ""))
        want = [(r or "", x or "") for _, r, x in turns]
        r = got[conv]
        assert C.read_turns(r.formatted) == want and r.n_turns == len(want)
        loss = [x for role, x in want if role == "assistant"]
        assert [C.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends, strict=True)] == loss
        d = digests[conv]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (d.loss_chars, d.formatted_chars) == (sum(map(len, loss)), len(r.formatted))


def test_empty_table(spark):
    assert C.digests(C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
