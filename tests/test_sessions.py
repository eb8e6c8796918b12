"""Sessions over a stream: the prompts of several batches are those of the whole table."""

import json
import random

from turnloom.streaming import sessions as S

SYSTEM, HISTORY = "be kind", 3


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("session", "seq", "kind", "content", "at"), r, strict=True))) for r in rows))


def prompts(spark, source, out, late=600, idle=86_400):
    S.run_available(S.read_events(spark, str(source), 1), str(out), SYSTEM, HISTORY, late, idle)
    rows = spark.read.schema(S.PROMPTS).parquet(str(out)).collect()
    found = [(r["session"], r["seq"], [tuple(m) for m in r["messages"]]) for r in rows]
    assert len({(s, q) for s, q, _ in found}) == len(found)
    return sorted(found)


def slow(events):
    out = []
    for session in {e[0] for e in events}:
        history = [("system", SYSTEM)]
        for _, seq, kind, content, _ in sorted({e[1]: e for e in events if e[0] == session}.values(), key=lambda e: e[1]):
            if kind == "system" and content.strip():
                history[0] = ("system", content.strip())
            elif kind == "clear":
                history = history[:1]
            elif kind in ("user", "assistant"):
                history.append((kind, content))
            if kind == "user":
                out.append((session, seq, history[:1] + history[1:][-HISTORY:]))
    return sorted(out)


def test_batches_in_any_order_give_the_batch_form(spark, tmp_path):
    rng, events = random.Random(7), []
    for s in range(12):
        kinds = [rng.choice(["user", "user", "assistant", "failed", "system", "clear"]) for _ in range(rng.randint(1, 12))]
        events += [(f"s{s}", i, k, rng.choice(["", " p ", f"t{i}"]), f"2024-01-01T00:0{rng.randint(0, 5)}:00Z") for i, k in enumerate(kinds)]
    arriving = events + rng.sample(events, 20)  # some come twice
    rng.shuffle(arriving)
    source, out = tmp_path / "in", tmp_path / "out"
    for part in range(3):
        arrive(source, f"a{part}", arriving[part::4])
    first = prompts(spark, source, out)
    expected = slow(events)
    assert [p for p in expected if p in first] == first  # each prompt at once right
    arrive(source, "b", arriving[3::4])  # a new query goes on from what was kept
    assert prompts(spark, source, out) == expected
    bounded = spark.read.schema(S.EVENTS).json(str(source))
    rows = S.prompts_of_batch(bounded, SYSTEM, HISTORY).collect()
    assert sorted((r["session"], r["seq"], [tuple(m) for m in r["messages"]]) for r in rows) == expected


def test_failed_calls_gaps_and_forgotten_sessions(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    at = lambda minute: f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"
    arrive(source, "1", [("a", 0, "user", "one", at(0)), ("a", 1, "failed", None, at(0)), ("a", 2, "user", "two", at(0)), ("a", 4, "user", "four", at(1))])
    assert prompts(spark, source, out, 60, 3600) == [("a", 0, [("system", SYSTEM), ("user", "one")]), ("a", 2, [("system", SYSTEM), ("user", "one"), ("user", "two")])]
    # number 3 never comes: once event time has passed by the allowance, the gap is passed over
    arrive(source, "2", [("b", 0, "user", "x", at(10))])
    arrive(source, "3", [("b", 1, "assistant", "y", at(11))])
    got = prompts(spark, source, out, 60, 3600)
    assert ("a", 4, [("system", SYSTEM), ("user", "one"), ("user", "two"), ("user", "four")]) in got
    # after an idle time the history is gone, but no turn is told again
    for i, minute in enumerate((100, 101, 102)):
        arrive(source, f"4{i}", [(f"c{i}", 0, "user", "z", at(minute))])
    prompts(spark, source, out, 60, 3600)
    arrive(source, "5", [("a", 4, "user", "four", at(103)), ("a", 5, "user", "five", at(103))])
    got = prompts(spark, source, out, 60, 3600)
    assert [p for p in got if p[0] == "a"][-1] == ("a", 5, [("system", SYSTEM), ("user", "five")])
    # and at last the session itself
    for i, minute in enumerate((400, 401, 402)):
        arrive(source, f"6{i}", [(f"d{i}", 0, "user", "z", at(minute))])
    prompts(spark, source, out, 60, 3600)
    state = spark.read.format("statestore").option("stateVarName", "place").load(f"{out}-state")
    assert not {"a", "b", "c0"} & {r["key"][0] for r in state.select("key").collect()}
