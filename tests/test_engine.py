import io
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from trailgrid import commands
from trailgrid import queries as Q
from trailgrid.functions import paths as P
from trailgrid.operators import extents as E
from trailgrid.operators import index as X
from trailgrid.operators import journal as J
from trailgrid.operators import live as V
from trailgrid.operators import overlay as O
from trailgrid.operators import resolve as R
from trailgrid.plans.engine import QueryPlan, Session, run
from trailgrid.plans.rules import files_matching, last_match_join, parse_file, resolve
from trailgrid.plans.scopes import Scope
from trailgrid.plans.search import accesses, search
from trailgrid.sources import image, mft, usn
from trailgrid.streaming import journal as SJ

SF = "/root/testdata/sf0.001"
ROW = "path string, has_deleted_entries boolean"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer part orders lineitem events documents pages labels".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    names = sorted(got.columns)
    table = duck.execute(Q.oracle_sql()[name]).to_arrow_table()
    assert sorted(table.column_names) == names
    want = sorted(map(repr, zip(*(table[c].to_pylist() for c in names), strict=True)))
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == want


def paths(spark, *rows):
    return spark.createDataFrame([(r, False) if isinstance(r, str) else r for r in rows], ROW)


def found(df):
    return sorted(r["path"] for r in df.collect())


def test_queries_on_paths(spark):
    rows = paths(spark, "a b c.txt", "abc.txt", "a/b/d/c.txt", "a/d/e.txt", "", "C:\\x\\.git\\y", "C:\\x\\p.git")
    assert found(run(rows, QueryPlan(("a b c",)))) == ["a b c.txt", "a/b/d/c.txt", "abc.txt"]
    assert found(run(rows, QueryPlan((".git>",)))) == ["C:\\x\\p.git"]
    assert run(rows, QueryPlan.of("all")).count() == 7
    assert found(run(rows, QueryPlan.of("prefix", "x", scopes=(Scope("c:\\X"),)))) == ["C:\\x\\.git\\y", "C:\\x\\p.git"]
    assert found(run(rows, QueryPlan(("<>",), limit=2))) == ["", "C:\\x\\.git\\y"]


def test_overlay(spark):
    base, over = paths(spark, "a", "b", "b"), paths(spark, ("a", True), "c")
    assert found(Session(base, over).query(QueryPlan(("<>",)))) == ["b", "c"]
    assert found(O.merge_prefiltered(base, over, ~F.col("has_deleted_entries"))) == ["a", "b", "b", "c"]
    assert sorted(map(tuple, O.diff(paths(spark, "kept", ("gone", True), "lost"), paths(spark, "kept", "came")).collect())) == [("came", False), ("lost", True)]
    seen = []
    assert Session(base).visit(QueryPlan(("<>",)), lambda r: seen.append(r) or False) == 1 and len(seen) == 1


def test_upsert_keeps_equal_rows(spark):
    """Paths that occur more than once on either side, and unknown ones, as NOT IN and UNION ALL have them."""
    over, rows = paths(spark, "a", "a", ("a", True), "b", (None, False)), paths(spark, "b", ("b", True), ("c", True), ("c", True))
    upserted = lambda o, r: sorted(map(repr, map(tuple, O.upsert(O.surely_absent(o, r), r).collect())))
    new = [("b", False), ("b", True), ("c", True), ("c", True)]
    assert upserted(over, rows) == sorted(map(repr, [("a", False), ("a", False), ("a", True), *new]))
    assert upserted(over, rows.unionByName(paths(spark, (None, False)))) == sorted(map(repr, [*new, (None, False)]))
    assert upserted(over, rows.limit(0)) == sorted(map(repr, map(tuple, over.collect())))
    assert sorted(map(tuple, commands.moved(paths(spark, "x"), "x", "x").collect())) == [("x", False)]


def test_overlay_keeps_drives_and_their_order(spark):
    base = X.build(paths(spark, "D:\\a.txt", "E:\\b.txt", "E:\\c.txt"), P.drive(F.col("path")))
    session = Session(base, paths(spark, ("E:\\c.txt", True), "E:\\a.txt", "F:\\z.txt"))
    assert found(session.query(QueryPlan((".txt>",), drives="E"))) == ["E:\\a.txt", "E:\\b.txt"]
    assert [r["path"] for r in session.query(QueryPlan((".txt>",), drives="ED", limit=3)).collect()] == ["E:\\a.txt", "E:\\b.txt", "D:\\a.txt"]
    assert [r["path"] for r in run(base, QueryPlan((".txt>",), drives="ED", limit=1)).collect()] == ["E:\\b.txt"]
    assert found(run(paths(spark, "D:\\a", "E:\\b"), QueryPlan(("<>",), drives="E"))) == ["E:\\b"]


def test_glob_rules_as_rows(spark):
    rules = resolve([parse_file("D:\\r.trail_rules", "EXCLUDE D:\\*.txt\nINCLUDE D:\\keep\n")])
    rows = last_match_join(paths(spark, "D:\\a.txt", "D:\\keep\\a.txt", "D:\\b.md"), rules.table(spark))
    assert {r["path"]: r["is_filtered"] for r in rows.collect()} == {"D:\\a.txt": True, "D:\\keep\\a.txt": False, "D:\\b.md": False}
    assert rows.columns == ["path", "has_deleted_entries", "is_filtered"]
    got = files_matching(paths(spark, "D:\\a.txt", "D:\\b.md"), rules.table(spark)).collect()
    assert [tuple(r) for r in got] == [("D:\\a.txt", "D:\\r.trail_rules")]


LINKS = "frn long, parent_frn long, namespace int, name string, is_deleted boolean"


def test_depth_and_cycles(spark):
    chain = [(100 + i, 99 + i if i else 5, 1, f"n{i}", False) for i in range(40)]
    circle = [(20, 22, 1, "x", False), (21, 20, 1, "y", False), (22, 21, 1, "z", False), (23, 21, 1, "w", False), (24, 24, 1, "own", False), (30, 77, 1, "o", False), (31, 30, 1, "p", False)]
    links = spark.createDataFrame(chain + circle, LINKS)
    listed = {r["frn"]: (r["path"], r["complete"]) for r in R.list_paths(links).collect()}
    assert len(listed) == 47 and listed[139] == ("\\".join(f"n{i}" for i in range(40)), True)
    assert {k: listed[k] for k in (20, 21, 22, 23, 24, 30, 31)} == {20: ("x", False), 21: ("x\\y", False), 22: ("x\\y\\z", False), 23: ("x\\y\\w", False), 24: ("own", False), 30: ("o", False), 31: ("o\\p", False)}
    paths_of = {r["frn"]: r["depth"] for r in R.resolve(links, "C:\\").collect()}
    assert paths_of == {100 + i: i + 1 for i in range(40)}
    hard = spark.createDataFrame([(10, 5, 1, "a", False), (11, 5, 1, "b", True), (12, 10, 1, "f", False), (12, 11, 1, "f", False), (11, 12, 1, "back", False)], LINKS)
    got = sorted((r["frn"], r["path"], r["has_deleted_entries"]) for r in R.resolve(hard, "C:\\").collect())
    assert got == [(10, "C:\\a", False), (11, "C:\\a\\f\\back", False), (11, "C:\\b", True), (12, "C:\\a\\f", False), (12, "C:\\b\\f", True)]


def test_index_round_trip(spark, tmp_path):
    rows = X.build(paths(spark, "C:/Src/A.TXT", "D:\\b", "C:\\src\\a.txt"), P.drive(F.col("path")))
    place = f"file://{tmp_path}/i"
    X.write(rows, place)
    back = X.read(spark, place)
    assert found(back) == ["C:\\Src\\A.TXT", "C:\\src\\a.txt", "D:\\b"] and X.violations(X.stored(spark, place, validate=True)).count() == 0
    assert found(run(back, QueryPlan((".txt>",), drives="C"))) == ["C:\\Src\\A.TXT", "C:\\src\\a.txt"]
    assert sorted((r["drive"], r["row_index"]) for r in back.collect()) == [("C", 0), ("C", 1), ("D", 0)]
    X.write(rows.limit(0), place, mode="ignore")
    assert X.read(spark, place).count() == 3
    with pytest.raises(FileExistsError):
        X.write(rows, place, mode="errorifexists")
    X.write(rows.where("drive = 'D'"), place)
    assert found(X.read(spark, place)) == ["D:\\b"] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["i"]
    spark.createDataFrame([('{"version": 1}',)], "value string").write.mode("overwrite").text(f"{place}/manifest")
    with pytest.raises(ValueError, match="version 1"):
        X.read(spark, place)


def test_damage_is_found_without_sending_tables_to_the_driver(spark, tmp_path):
    place = f"file://{tmp_path}/i"
    X.write(X.build(paths(spark, "C:\\one\\a.txt", "C:\\two"), P.drive(F.col("path"))), place)
    index = X.stored(spark, place)
    bad = X.violations(X.Stored(index.rows, index.postings.where("segment <> 'two'"), index.trigrams.where("segment <> 'one'")))
    assert "BroadcastHashJoin" not in bad._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["kind"], r["segment"]) for r in bad.collect()) == [("no posting", "two"), ("no trigram", "one")]


def test_ways_to_rows_are_pushed_down(spark, tmp_path):
    names = ["Flora.txt", "flow.tar.gz", "reflow.JAR", "Kelvin.md", "a.git"]
    rows = X.build(paths(spark, *(f"C:\\d{i}\\{n}" for i, n in enumerate(names * 3)), "D:\\flow\\x.jar"), P.drive(F.col("path")))
    X.write(rows, f"file://{tmp_path}/i")
    index = X.stored(spark, f"file://{tmp_path}/i")
    plans = {
        "term": QueryPlan(("<a.git>",)), "ext": QueryPlan((".jar>",), compat="index"), "trigrams": QueryPlan(("flow .jar>",)),
        "segments": QueryPlan(("<fl",)), "scan": QueryPlan(("fl|.jar>",)),
    }
    for way, plan in plans.items():
        assert [a.way for a in accesses(plan)] == [way]
        assert found(search(index, plan)) == found(run(rows, plan)) != []
    two = QueryPlan(("flow", "<kelvin.md>", "flow.tar .gz>"), limit=4)
    assert [a.way for a in accesses(two)] == ["trigrams", "term", "trigrams"]
    assert [r["path"] for r in search(index, two).collect()] == [r["path"] for r in run(index.rows, two).collect()]

    def pushed(df):
        return " ".join(x for x in df._jdf.queryExecution().toString().splitlines() if "PushedFilters" in x)

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    assert "EqualTo(term,a.git)" in pushed(search(index, plans["term"]))
    assert "EqualTo(ext,.jar)" in pushed(search(index, plans["ext"]))
    assert "In(trigram" in pushed(search(index, plans["trigrams"])) or "EqualTo(trigram" in pushed(search(index, plans["trigrams"]))
    assert "StringStartsWith(segment,fl)" in pushed(search(index, plans["segments"]))
    assert "StringStartsWith(place,c:\\d1\\)" in pushed(run(index.rows, QueryPlan(("<>",), scopes=(Scope("C:/D1"),))))


EVENTS = "frn long, parent_frn long, usn long, reason long, file_attributes long, name string"


def test_rename_in_journal(spark, tmp_path):
    old, new = (41, 6, 301, 0x1000, 32, "draft.md"), (41, 6, 302, 0x2000, 32, "final.md")
    base = spark.createDataFrame([(41, 6, "draft.md", False), (42, 6, "other.md", False)], "frn long, parent_frn long, name string, is_deleted boolean")
    want = [("draft.md", True), ("final.md", False), ("other.md", False)]
    assert sorted((r["name"], r["is_deleted"]) for r in J.apply(base, spark.createDataFrame([old, new], EVENTS)).collect()) == want
    folder, table = str(tmp_path / "in"), f"file://{tmp_path}/t"
    spark.createDataFrame([(usn.encode([old], 2),), (usn.encode([new], 3),)], "buffer binary").write.parquet(folder)
    state, head = {"journal_id": 9, "snapshot_usn": 300, "next_usn": 300}, {"journal_id": 9, "lowest_valid_usn": 200, "next_usn": 400}
    go = lambda cursor: SJ.publish(SJ.read_buffers(spark, folder), base, table, str(tmp_path / "c"), state=state, cursor=lambda: cursor)
    go(head).awaitTermination(60)
    store = SJ.LinkTable(spark, table)
    assert sorted((r["name"], r["is_deleted"]) for r in store.links().collect()) == want
    first = store.manifest()
    assert first["checkpoint"]["next_usn"] == 302
    untouched = {b: v for b, v in first["buckets"].items() if v == -1}
    spark.createDataFrame([(usn.encode([(41, 6, 303, 0x200, 32, "final.md")]),)], "buffer binary").write.mode("append").parquet(folder)
    go(head).awaitTermination(60)
    assert sorted((r["name"], r["is_deleted"]) for r in store.links().collect()) == [("draft.md", True), ("final.md", True), ("other.md", False)]
    assert {b: v for b, v in store.manifest()["buckets"].items() if v == -1} == untouched
    spark.createDataFrame([(usn.encode([(41, 6, 304, 0x100, 32, "late.md")]),)], "buffer binary").write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="gone from the journal"):
        go(head | {"lowest_valid_usn": 301}).awaitTermination(60)
    assert store.manifest()["checkpoint"]["next_usn"] == 303 and SJ.poll_ms(None) == 500 and SJ.poll_ms(3) == 50


def test_paths_as_of_each_event(spark):
    base = spark.createDataFrame([(10, 5, "music"), (11, 10, "song")], "frn long, parent_frn long, name string")
    rows = [(11, 10, 1, 0x1000, 32, "song"), (11, 10, 2, 0x2000, 32, "tune"), (10, 5, 3, 0x2000, 16, "sound"), (11, 10, 4, 0x200, 32, "tune"), (11, 10, 5, 0x1, 32, "tune"), (50, 49, 6, 0x100, 32, "lost")]
    seen = {r["usn"]: r for r in V.observed(spark.createDataFrame(rows, EVENTS), base, "C:\\").collect()}
    two = ["C:\\music\\song", "C:\\music\\tune"]
    assert {u: r["projected_paths"] for u, r in seen.items()} == {1: two[:1], 2: two, 3: ["C:\\music", "C:\\sound"], 4: two + ["C:\\sound\\song", "C:\\sound\\tune"], 6: []}
    assert seen[3]["is_directory"] and seen[2]["reason_names"] == ["rename-new-name"]
    assert sorted(r["usn"] for r in V.within(V.observed(spark.createDataFrame(rows, EVENTS), base, "C:\\"), [Scope("c:/sound")]).collect()) == [3, 4]


def test_watch_sees_paths_and_keeps_links(spark, tmp_path):
    base = spark.createDataFrame([(10, 5, "music")], "frn long, parent_frn long, name string")
    folder, seen = str(tmp_path / "in"), []
    see = lambda df: seen.extend((r["usn"], r["projected_paths"]) for r in df.collect())
    for k, rows in enumerate([[(11, 10, 1, 0x100, 32, "song")], [(10, 5, 2, 0x2000, 16, "sound"), (11, 10, 3, 0x1, 32, "song")], [(11, 10, 4, 0x200, 32, "song")]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        scopes = [Scope("C:\\sound")] if k == 2 else None
        SJ.watch(SJ.read_events(spark, folder), base, "C:\\", str(tmp_path / "c"), see, scopes, f"file://{tmp_path}/w").awaitTermination(60)
    assert seen == [(1, ["C:\\music\\song"]), (2, ["C:\\music", "C:\\sound"]), (4, ["C:\\music\\song", "C:\\sound\\song"])]


def test_warm_drives_answer(spark):
    rows = X.build(paths(spark, "D:\\a.txt", "E:\\b.txt", "E:\\c.md"), P.drive(F.col("path")))
    session = Session(rows)
    assert session.warm(["E", "D"]) == {"E": 2, "D": 1}
    warm = session.query(QueryPlan((".txt>",), drives="E"))
    assert found(warm) == ["E:\\b.txt"] and "InMemory" in warm._jdf.queryExecution().toString()
    session.cool()
    assert found(session.query(QueryPlan((".txt>",), drives="E"))) == ["E:\\b.txt"] and not session.held


def test_answers_of_some_drives(spark):
    def broken():
        raise OSError("no medium")

    rows, failed = V.answered({"C": lambda: paths(spark, "C:\\a"), "D": broken})
    assert found(rows) == ["C:\\a"] and failed == {"D": "no medium"}
    with pytest.raises(RuntimeError, match="D: no medium"):
        V.answered({"D": broken})
    assert V.index_sources({"C", "D", "E"}, {"D", "Z"}) == (["C", "E"], ["D"])


def test_lines_and_commands(spark):
    rows = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", True, True)], "path string, has_deleted_entries boolean, is_filtered boolean").coalesce(1)
    out = io.StringIO()
    assert commands.show(rows, out, colour=True) == 3 and out.getvalue().count("\x1b[") == 6
    assert out.getvalue().splitlines()[2] == "\x1b[33mc\x1b[39m" and commands.show(rows, io.StringIO(), stop=lambda: True) == 0
    assert sorted(map(tuple, commands.moved(paths(spark, "x", "old"), "old", "new").collect())) == [("new", False), ("old", True), ("x", False)]
    assert commands.query_journals(spark, [{"drive": "D"}, {"drive": "C", "journal_id": 171, "first_usn": 1, "next_usn": 9, "lowest_valid_usn": 2}]) == ["C: journal 00000000000000ab, events 1 to 9, valid from 2", "D: no journal"]
    assert commands.columns(["a", "bb", "c"], 6) == ["a   c", "bb"]


def test_file_table(spark, tmp_path):
    long = mft.pack_record([(5, 1, "a.txt"), (6, 2, "A~1")], flags=3)
    (tmp_path / "m.bin").write_bytes(long + mft.pack_record([(5, 1, "gone")], flags=0))
    table = mft.read_records(spark, str(tmp_path / "m.bin"))
    assert [tuple(r) for r in mft.fixup_counts(table).collect()] == [("applied", 2)]
    assert {r["entry_id"]: (r["is_deleted"], r["is_directory"]) for r in table.collect()} == {0: (False, True), 1: (True, False)}
    links = sorted((r["frn"], r["parent_frn"], r["namespace"], r["name"], r["is_deleted"]) for r in mft.read_links(table).collect())
    assert links == [(0, 5, 1, "a.txt", False), (0, 6, 2, "A~1", False), (1, 5, 1, "gone", True)]
    fixed = bytearray(mft.fixup(long)[0])
    assert mft.fixup(bytes(fixed))[1] == "already" and len(list(mft.names(bytes(fixed)))) == 2
    struct.pack_into("<I", fixed, 0x18, 0x60)  # a record that uses less than its attributes need
    assert list(mft.names(bytes(fixed))) == []
    assert mft.run_list(bytes([0x11, 4, 0xFE, 0x01, 3, 0])) == [(4, -2), (3, None)]
    runs = [(4, -2), (3, None), (300, 70_000), (1, 128), (5, -40_000)]
    assert mft.run_list(mft.pack_run_list(runs)) == runs
    boot = bytearray(512)
    struct.pack_into("<HB", boot, 0x0B, 512, 8)
    struct.pack_into("<b", boot, 0x40, -10)
    assert mft.boot_sector(bytes(boot))["record_size"] == 1024
    for bad in (b"x" * 100, b"\0" * 2048):
        with pytest.raises(ValueError):
            list(mft.records(bad))


def test_pieces_of_a_device(spark):
    chunks = spark.createDataFrame([(0, bytes(range(100))), (1, bytes(range(100, 200))), (3, b"z" * 50)], "chunk long, data binary")
    extents = "file int, logical_offset long, length long, physical_offset long"
    parts = spark.createDataFrame([(1, 0, 60, 70), (1, 60, 20, None), (1, 80, 10, 5), (2, 0, 0, 7)], extents)
    block = image.snapshot(image.reassembled(parts, chunks, chunk=100, holes=True), 1000).collect()
    assert [(r["file"], bytes(r["data"])) for r in block] == [(1, bytes(range(70, 130)) + bytes(20) + bytes(range(5, 15)))]
    assert [(r["n_reads"], r["n_bytes"]) for r in image.bytes_read(image.read_plan(parts, 100)).collect()] == [(3, 70)]
    records = image.fixed_records(image.reassembled(parts.limit(1), chunks, chunk=100), 25).orderBy("entry_id").collect()
    assert [bytes(r["record"]) for r in records] == [bytes(range(70, 95)), bytes(range(95, 120))]
    for lost in ([(1, 0, 10, 200)], [(1, 0, 60, 300)]):
        with pytest.raises(Exception, match="holds no data at"):
            image.reassembled(spark.createDataFrame(lost, extents), chunks, chunk=100).collect()


def test_stretches_and_blocks_change_nothing(spark):
    rng = random.Random(3)
    rows, runs = [], []
    for file in range(3):
        at = 0
        for k in range(200):
            at += rng.choice([0, 0, 0, 7, 30])
            n = rng.randint(1, 40)
            rows.append((file, at, n))
            at += n
            runs.append((file, k, rng.randint(0, 5), rng.choice([None, rng.randint(-9, 9)])))
    rows += [(0, 10, 50), (0, 10, 3)]  # overlapping ones are not joined
    extents = spark.createDataFrame(rows, "file int, offset long, length long")
    whole = sorted(map(tuple, E.merge(extents).collect()))
    want = []
    for file in range(3):
        own = []
        for _, at, n in sorted(r for r in rows if r[0] == file):
            if own and end == at:  # noqa: F821
                own[-1][1] += n
            else:
                own.append([at, n])
            end = at + n
        want += [(file, *x) for x in own]
    assert whole == sorted(want)
    for width in (16, 100, 999):
        assert sorted(map(tuple, E.merge(extents, width=width).collect())) == whole
    table = spark.createDataFrame(runs, "file int, run_no int, clusters long, delta long")
    one = sorted(map(tuple, E.runs_to_extents(table, 512).collect()), key=repr)
    assert one == sorted(map(tuple, E.runs_to_extents(table, 512, block=13).collect()), key=repr) and len(one) > 400


def test_journal_buffers():
    events = [(5, -3, 9, 0x80000100, 32, "ä.txt"), (1 << 40, 2, 10, 0x200, 16, "b")]
    assert list(usn.decode(usn.encode(events, 2) + usn.encode(events[:1], 3))) == events + events[:1]
    odd = bytearray(usn.encode(events))
    struct.pack_into("<H", odd, 4, 4)
    assert list(usn.decode(bytes(odd))) == events[1:]
    for bad in (b"\0" * 16, usn.encode(events)[:-8]):
        with pytest.raises(ValueError):
            list(usn.decode(bad))
