import json

from pyspark.sql import functions as F

from pitpanel.functions.names import normalize_name, person_like
from pitpanel.sources import feeds


def payload(data, included=None):
    return json.dumps({"data": data, "included": included or []})


def prop(pid="9", **a):
    attrs = {"stat_type": "Pass Yards", "line_score": 245.5, "odds_type": "standard", "description": "KC", **a}
    return {"type": "projection", "id": "1", "attributes": attrs, "relationships": {"new_player": {"data": {"id": pid}}}}


MARSTEN = {"type": "new_player", "id": "9", "attributes": {"name": "Quill Marsten", "team": "KC", "position": "QB"}}


def rows(spark, text):
    docs = spark.createDataFrame([(1, text)], "id int, t string")
    return sorted(feeds.parse_any(docs, "id", "t").collect(), key=lambda r: r["pos"])


def test_one_projection(spark):
    (r,) = rows(spark, payload([prop()], [MARSTEN]))
    assert (r["name"], r["team"], r["position"], r["line"], r["direction"], r["reject_reason"]) == ("Quill Marsten", "KC", "QB", 245.5, "both", None)


def test_missing_player_list_is_a_reject(spark):
    (r,) = rows(spark, payload([prop()]))
    assert r["reject_reason"] == "no_name"
    (r,) = rows(spark, payload([prop(description="Tobin Ashe")]))
    assert (r["name"], r["reject_reason"]) == ("Tobin Ashe", None)


def test_bad_elements_cost_only_themselves(spark):
    data = ["x", 7, None, prop(), prop(line_score="n/a"), prop(line_score="Infinity"), prop(line_score="1e400"), prop(line_score=None), {"type": "other"}]
    got = [(r["pos"], r["reject_reason"]) for r in rows(spark, payload(data, ["odd", MARSTEN]))]
    assert got == [(3, None), (4, "bad_line"), (5, "bad_line"), (6, "bad_line"), (7, "no_name")]


def test_last_player_record_wins(spark):
    other = {"type": "player", "id": "9", "attributes": {"display_name": "Q. Marsten", "team_name": "KAN"}}
    (r,) = rows(spark, payload([prop()], [MARSTEN, other]))
    assert (r["name"], r["team"]) == ("Q. Marsten", "KAN")


def test_restrictions(spark):
    cases = {None: "both", "over": "more", "under": "less"}
    for raw, want in cases.items():
        (r,) = rows(spark, payload([prop(allowed_wager_types=raw)], [MARSTEN]))
        assert r["direction"] == want
    for raw, want in ((["over"], "more"), (["over", "under"], "both"), (["sideways"], "both"), ([], "both")):
        (r,) = rows(spark, payload([prop(allowed_wager_types=raw)], [MARSTEN]))
        assert r["direction"] == want


def test_hostile_text_never_raises(spark):
    for text in ("", None, "{", "[", "[1, 2]", "{}", '{"data": 5}', '{"data": {"a": 1}}', "null", "\x00\x01", "a\n" * 50, '{"data": ["x"]}'):
        assert rows(spark, text) == []


BOARD = "Quill Marsten\nKC - QB\n245.5\nPass Yards\nDale Orwin\nKC - WR\n64.5\nReceiving YardsDemon\nKC\nKC - TM\n44.5\nTeam Total\n"


def test_board(spark):
    got = rows(spark, BOARD)
    assert [(r["name"], r["line"], r["stat_type"], r["odds_type"], r["direction"]) for r in got] == [
        ("Quill Marsten", 245.5, "Pass Yards", "standard", ""),
        ("Dale Orwin", 64.5, "Receiving Yards", "demon", ""),
    ]


def test_board_buttons(spark):
    for tail, want in (("Less\nMore", "both"), ("More", "more"), ("Less", "less"), ("", ""), ("Less\nLess\nLess\nMore", "both")):
        (r,) = rows(spark, f"Tobin Ashe\n1.5\nPass TDs\n{tail}\nend\n")
        assert r["direction"] == want


#: Texts of one line each, separated by |, and the records they hold: (line number, name, number, stat).
PINNED = [
    ("Tobin Ashe|12.5|Rush Yards", [(0, "Tobin Ashe", 12.5, "Rush Yards")]),
    ("Tobin Ashe|KC - QB|7|Rush Yards|Less", [(0, "Tobin Ashe", 7.0, "Rush Yards")]),
    # A name that follows a name starts anew.
    ("Tobin Ashe|Ina Moss|7|KC", [(1, "Ina Moss", 7.0, "KC")]),
    # The stat of one record is never the name of the next, even where it looks like one.
    ("Tobin Ashe|7|Ina Moss|12.5|Rush Yards", [(0, "Tobin Ashe", 7.0, "Ina Moss")]),
    ("Tobin Ashe|7|Rush Yards|Ina Moss|12.5|x", [(0, "Tobin Ashe", 7.0, "Rush Yards"), (3, "Ina Moss", 12.5, "x")]),
    # "Rush Yards" is like a name where a number and a further line follow.
    ("Less|Rush Yards|12.5|More|Less", [(1, "Rush Yards", 12.5, "More")]),
    ("Rush Yards|KC - QB|Tobin Ashe|7|7", [(2, "Tobin Ashe", 7.0, "7")]),
    # No line after the number, no number, two team lines, a team line alone.
    ("Tobin Ashe|12.5", []),
    ("Tobin Ashe|KC|Rush Yards|x", []),
    ("Tobin Ashe|KC - QB|KC - QB|7|x", []),
    ("KC|12.5|Rush Yards|x", []),
    # Blank lines do not count.
    ("| |Ina Moss||KC - QB||7||x|", [(0, "Ina Moss", 7.0, "x")]),
]


def test_overlapping_candidates_follow_the_record_rule(spark):
    docs = spark.createDataFrame([(i, t.replace("|", "\n")) for i, (t, _) in enumerate(PINNED)], "id int, t string")
    got = {}
    for r in feeds.parse_board(docs, "id", "t").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["name"], r["line"], r["stat_type"]))
    for i, (t, want) in enumerate(PINNED):
        assert sorted(got.get(i, [])) == want, t


def test_markers_in_linear_time(spark):
    import time

    big = "Rush Yards" + "DemonGoblin" * 40_000
    kept = ["Rush\ufffeYards", "x\uffff", "y\ufffd1\ufffe", "\ufffd0"]
    df = spark.createDataFrame([(x,) for x in [big, "Demon Time", "XDemonDemon", "Goblin", *kept, "z\uffffDemon"]], "s string")
    t = time.time()
    assert [r[0] for r in df.select(feeds.strip_markers(F.col("s"))).collect()] == ["Rush Yards", "Demon Time", "X", "", *kept, "z\uffff"]
    assert time.time() - t < 20


def test_names_are_folded(spark):
    pinned = {
        "Re'Nell Voss": "re nell voss", "Owen Barlow Jr.": "owen barlow", "José  Núñez III": "jose nunez", "ﬁn Šimůnek": "fin simunek", "e\u0301a": "ea",
        "Ø Ł ß": "", "ÀÉÎÕÜ ç": "aeiou c", "Ｆｕｌｌ Ｗｉｄｔｈ": "full width", "A-B.C IV": "a b c", "ivy vi": "ivy vi", "  x  V ": "x", "½ Ⅷ": "1 2 viii", "漢字 kanji": "kanji", "": "",
    }
    df = spark.createDataFrame(list(pinned.items()), "n string, want string")
    assert [(r["n"], r["got"]) for r in df.select("n", normalize_name(F.col("n")).alias("got"), "want").where("got <> want").collect()] == []
    assert df.select(normalize_name(F.lit(None))).first()[0] == ""


def test_people(spark):
    df = spark.createDataFrame([(s,) for s in ["KC", "SF", "NYG", "TB", "", None, "QB", "A B C", "Quill Marsten", "Re'Nell Voss"]], "s string")
    assert [r[0] for r in df.select(person_like(F.col("s"))).collect()] == [False] * 8 + [True, True]


def test_snapshot_history(spark, tmp_path):
    from pitpanel.operators.windows import latest_before
    from pitpanel.sources.tables import json_snapshots

    base = {"player": "A B", "stat": "Rush Yards", "startTimeIso": "2025-09-07T17:00:00Z"}
    for n, (at, line) in enumerate([("2025-09-05T10:00:00Z", 40.5), ("2025-09-07T16:00:00Z", 44.5), ("2025-09-07T18:00:00Z", 60.5)]):
        (tmp_path / f"s{n}.json").write_text(json.dumps({"scrapedAt": at, "props": [{**base, "line": line}, "junk", {"player": "C"}]}))
    (tmp_path / "bad.json").write_text("{nope")
    snaps = json_snapshots(spark, str(tmp_path))
    p = feeds.snapshot_props(snaps, "scraped", "payload")
    best = latest_before(p, ["player", "stat"], "scraped_at", "start_at", ["line"]).collect()
    assert [(r["player"], r["line"]) for r in best] == [("A B", 44.5)]
