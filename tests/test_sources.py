"""Sources and sinks: inferred schemas, logs by byte ranges, versions, settings by key, resumed features, reads of bytes."""

import codecs
import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators import streams as S
from turnloom.sources import tables
from turnloom.sources.logs import read_log
from turnloom.sources.schema import infer_schema, read_json_lines
from turnloom.sources.settings import SettingsStore
from turnloom.sources.sink import FeatureSink
from turnloom.sources.versions import Overtaken, VersionedTable

# ---------------------------------------------------------------- schemas


def test_schema_is_that_of_all_lines_however_they_are_dealt_out(spark):
    lines = ['{"a": 1, "b": null}', '{"a": 2.5, "b": null}', '{"b": null, "c": {"x": "s"}}', '{"c": {"x": 7, "y": [1, 2.5]}}', '{"d": [{"k": 1}]}', '{"d": [{"l": "z"}]}', "[1, 2]", '"text"', "broken", '{"e f": {"g-h": true}}'] + ['{"a": 3}'] * 40 + ['{"late": {"deep": [[1]]}}']
    rng, schemas = random.Random(1), []
    for parts in (1, 3, 8):
        rng.shuffle(lines)
        schemas.append(infer_schema(spark.createDataFrame([(x,) for x in lines], "line string").repartition(parts)))
    assert schemas[0] == schemas[1] == schemas[2]
    kinds = {f.name: f.dataType for f in schemas[0].fields}
    assert kinds["a"] == T.DoubleType() and kinds["b"] == T.StringType()
    assert kinds["c"] == T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.ArrayType(T.DoubleType()))])
    assert kinds["d"] == T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("l", T.StringType())]))
    assert kinds["e f"] == T.StructType([T.StructField("g-h", T.BooleanType())])
    assert kinds["late"] == T.StructType([T.StructField("deep", T.ArrayType(T.ArrayType(T.LongType())))])
    assert infer_schema(spark.createDataFrame([], "line string")) == T.StructType([])


def test_typed_lines(spark, tmp_path):
    rows = [{"a": 1, "m": "x"}, {"a": 2.5, "m": {"k": [1]}}, {"late": True, "m": 3}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = read_json_lines(spark, str(tmp_path / "in.jsonl")).collect()
    assert sorted(((r["a"], r["late"], r["m"].replace(" ", "")) for r in got), key=repr) == sorted([(1.0, None, "x"), (2.5, None, '{"k":[1]}'), (None, True, "3")], key=repr)


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"messages": [{"role": "user", "content": "a"}]}\n')
    read = tables.read_conversations(spark, str(tmp_path / "in.jsonl"), calls=True)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("tl_parsed#") > 1
    assert read.first()["messages"][0]["content"] == "a"


# ---------------------------------------------------------------- logs


def test_log_by_byte_ranges(spark, tmp_path):
    rng, folder = random.Random(2), tmp_path / "log"
    for run in ("a", "b"):
        for k in range(2):
            text = "".join(rng.choice(["x" * rng.randint(0, 90), "{'loss': 1.0}", "\u4f60\u597d"]) + rng.choice(["\n", "\r", "\r\n", "\n\n"]) for _ in range(400))
            (folder / f"run={run}").mkdir(parents=True, exist_ok=True)
            (folder / f"run={run}" / f"part-{k}.txt").write_bytes(text.encode())
    expected = {}
    for run in ("a", "b"):
        whole = b"\n".join((folder / f"run={run}" / f"part-{k}.txt").read_bytes() for k in range(2))
        expected[run] = [x.decode() for x in re.split(rb"[\r\n]+", whole) if x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1kb", "100kb", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1kb" else "4194304")
            lines = read_log(spark, str(folder))
            rows = lines.collect()
            if size == "1kb":
                assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
            for run in ("a", "b"):
                own = {r["pos"]: r["value"] for r in rows if r["run"] == run}
                assert [own[i] for i in range(len(own))] == expected[run] and len(own) == sum(r["run"] == run for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---------------------------------------------------------------- versions


def test_versions_are_seen_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    assert table.parts() == (0, []) and table.read() is None
    first = table.write(rows(1, 2))
    assert table.read() is None  # written, not committed
    assert table.commit(0, [first]) == 1
    reader = table.read()
    second = table.write(rows(3))
    with pytest.raises(Overtaken):
        table.commit(0, [second])  # another writer has version 1
    assert table.change(lambda _, parts: [*parts, second]) == 2
    assert sorted(r["n"] for r in reader.collect()) == [1, 2]  # a reader keeps the version that it began with
    assert sorted(r["n"] for r in table.read().collect()) == [1, 2, 3] and sorted(r["n"] for r in table.read(1).collect()) == [1, 2]
    tries = []

    def overtaken(version, parts):
        tries.append(version)
        if len(tries) == 1:
            table.commit(version, parts)  # somebody else, just now
        return parts

    assert table.change(overtaken) == 4 and tries == [2, 3]
    table.write(rows(9))  # never committed
    table.keep_last(2)
    assert table.versions() == [3, 4] and len(table._names("parts")) == 2
    assert [n for n in table._names("commits") if n.startswith(".") and not n.endswith(".crc")] == []


def test_settings_by_key(spark, tmp_path):
    store = SettingsStore(spark, str(tmp_path / "s"), "client")
    rows = lambda *r: spark.createDataFrame(list(r), "client string, url string, n int")
    shown = lambda df: {tuple(r) for r in df.collect()}
    with pytest.raises(LookupError):
        store.get()
    store.set(rows(("a", "u1", 1), ("b", "u2", 2)))
    store.set(rows(("a", "u3", None)))
    assert shown(store.get()) == {("a", "u3", None), ("b", "u2", 2)}
    store.remove(spark.createDataFrame([("b",), ("never",)], "client string"))
    assert shown(store.get()) == {("a", "u3", None)} and shown(store.get(1)) == {("a", "u1", 1), ("b", "u2", 2)}
    reader = store.get()
    store.set(rows(("b", "u4", 4)))
    assert shown(reader) == {("a", "u3", None)}  # the state that was there when it began
    assert shown(store.get_one("b")) == {("b", "u4", 4)} and shown(store.get_one("x")) == set()
    before = shown(store.get())
    store.compact(keep=1)
    assert shown(store.get()) == before and len(store.table.parts()[1]) == 1 and len(store.table.versions()) == 1
    store.set(rows(("a", "u5", 5)))
    assert shown(store.get()) == {("a", "u5", 5), ("b", "u4", 4)}


def test_stopped_features_go_on(spark, tmp_path):
    inputs = []
    for k in range(7):
        path = tmp_path / f"in{k}.txt"
        path.write_text("\n".join(f"{k}-{i}" for i in range(5)))
        inputs.append(str(path))
    sink, seen = FeatureSink(spark, str(tmp_path / "out")), []

    def build(some):
        seen.append(list(some))
        if len(seen) == 3:
            raise RuntimeError("lost")
        return spark.read.text(some)

    with pytest.raises(RuntimeError, match="lost"):
        sink.run(inputs, build, group=2)
    assert sink.features().count() == 20 and sink.missing(spark.createDataFrame([(i,) for i in inputs], "input string")).count() == 3
    assert sink.run(inputs, build, group=2) == 2
    rows = [r["value"] for r in sink.features().collect()]
    assert sorted(rows) == sorted(f"{k}-{i}" for k in range(7) for i in range(5))
    assert sorted(x for part in seen[:2] + seen[3:] for x in part) == sorted(inputs)  # nothing twice
    assert sink.run(inputs, build) == 0 and len(sink.table.versions()) == 2
    # a part that was written but not committed counts for nothing
    sink.table.write(spark.createDataFrame([("x",)], "value string"))
    assert sink.features().count() == 35


# ---------------------------------------------------------------- reads of bytes


def browser(reads, mode):
    """Content as a browser takes it from the reads of a reply."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    texts = [decoder.decode(r) for r in reads]
    out = ""
    for text in texts if mode == "lossy" else ["".join(texts)]:
        for line in text.split("\n"):
            if line.startswith("data: ") and line[6:] != "[DONE]":
                try:
                    out += (json.loads(line[6:])["choices"][0]["delta"].get("content")) or ""
                except (ValueError, KeyError, IndexError):
                    pass
    return out


def test_reads_cut_at_every_byte(spark):
    event = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]}, ensure_ascii=False) + "\n\n"
    whole = ("\ufeff" + event("a\u00e9") + event("\u4f60\U0001F600") + event("end")).encode() + b"data: [DONE]\n\n" + "\U0001F600".encode()[:2]
    cuts = {f"at{i}": [whole[:i], whole[i:]] for i in range(len(whole) + 1)}
    cuts |= {"bytes": [whole[i : i + 1] for i in range(len(whole))], "threes": [whole[i : i + 3] for i in range(0, len(whole), 3)], "broken": [b"data: \xf0\x9f", b"\n" + whole, b"\xff\n"], "none": [None, b""]}
    rows = [(k, i, r) for k, reads in cuts.items() for i, r in enumerate(reads)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "reply string, seq int, data binary").repartition(5)
    for mode in ("lossy", "buffered"):
        got = {r["reply"]: r["content"] for r in S.decode_bytes(frame, "reply", mode=mode).collect()}
        assert got == {k: browser([r or b"" for r in reads], mode) for k, reads in cuts.items()}
    assert got["bytes"] == got["at40"] == "a\u00e9\u4f60\U0001F600end"
    joined = S.texts_of_reads(frame, "reply").where(F.col("reply") == "bytes").orderBy("seq").collect()
    assert "".join(r["data"] for r in joined) == whole[3:-2].decode()


def test_requests_are_answered_once(spark, tmp_path):
    """Over several runs, and where a batch failed before or after its part was committed."""
    from turnloom.streaming import endpoint

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    request = lambda i, text, **more: json.dumps({"request_id": i, "messages": [{"role": "user", "content": text}], **more})
    respond = lambda r: r.select("request_id", F.upper(F.col("messages")[0]["content"]).alias("content"))
    serve = lambda f=respond: endpoint.serve_available(endpoint.read_requests(spark, str(source), 1), f, out)

    def shown():
        rows = sorted(endpoint.answered(spark, out).collect())
        return {i: [r["event"] for r in rows if r["request_id"] == i] for i in {r["request_id"] for r in rows}}

    (source / "1").write_text(request("a", "hi", stream=True) + "\n" + request("b", "yo") + "\n{}\nbroken\n")
    serve()
    first = shown()
    assert len(first["a"]) == 4 and first["a"][-1] == "data: [DONE]\n\n" and json.loads(first["b"][0])["choices"][0]["message"]["content"] == "YO"
    (source / "2").write_text(request("c", "x", stream=True))

    def fails(rows):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        serve(fails)
    # the part of the failed batch was written, not committed
    endpoint.VersionedTable(spark, out).write(spark.createDataFrame([("c", 0, "half")], endpoint.EVENTS), "batch-000000000001")
    serve()
    assert {k: v for k, v in shown().items() if k != "c"} == first and len(shown()["c"]) == 3
    # a batch that is run again after its commit changes nothing
    newest = sorted((tmp_path / "out-progress" / "commits").glob("[0-9]*"))[-1]
    newest.unlink()
    for crc in (tmp_path / "out-progress" / "commits").glob(f".{newest.name}.crc"):
        crc.unlink()
    before = shown()
    serve(fails)
    assert shown() == before
