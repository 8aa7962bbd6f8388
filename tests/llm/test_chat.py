import random

import pytest
from siltworks.llm.chat import format_windows, read_back

HARD = ["\\### Assistant: </turn> ok", "\\l<\\b\\\\n", "<again>x</turn>\n<turn>assistant\nno", "", None, "é𝄞 three words", "w " * 40, "\n\n"]


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "system", None, "a\nb\\n<"])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 3]), role, rng.choice(HARD), "x"))
    rows += rows[:9]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")


def grouped(rows):
    out = {}
    for c, turn, role, text, _ in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("budget,history,turns", [(1024, 128, 2), (60, 20, 3), (10, 0, 0), (90, 60, 1)])
def test_round_trip(conversations, budget, history, turns):
    rows, frame = conversations
    want = grouped(rows)
    windows = format_windows(frame, budget=budget, history_tokens=history, history_turns=turns)
    back = {r.conv_id: r for r in read_back(windows).collect()}
    assert back.keys() == want.keys()
    for c, own in want.items():
        assert back[c].turns == "".join(f"{r}\n{t}\n" for r, t in own)
        assert back[c].n_turns == len(own)
        assert back[c].loss == "".join(t for r, t in own if r == "assistant")
    for w in windows.collect():
        own = w.formatted.count("<turn>")
        again = w.formatted.count("<again>")
        if w.n_tokens > budget:  # the system turn and one turn are over the budget alone
            system = want[w.conv_id][0][0] == "system"
            assert own + again <= 1 + system
        assert again <= turns + 1
        if want[w.conv_id][0][0] == "system":
            assert w.formatted.startswith("<turn>system\n" if w.window == 1 else "<again>system\n")
        for s in w.loss_spans:
            assert w.formatted[: s.start].endswith("<turn>assistant\n") and w.formatted[s.end :].startswith("</turn>\n")


def test_large_system_turn(spark):
    """System turn of 904 tokens, three turns of 64: none of the windows may pass 1024."""
    rows = [(1, 0, "system", "s " * 900)] + [(1, t, "user", "u " * 60) for t in (1, 2, 3)]
    windows = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(windows) > 1 and all(w.n_tokens <= 1024 for w in windows), [w.n_tokens for w in windows]


def test_empty(spark):
    assert read_back(format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_plan_has_no_user_function(conversations):
    plan = read_back(format_windows(conversations[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1
