import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trailgrid.functions.globs import to_regex
from trailgrid.plans.querylang import Rule, parse
from trailgrid.plans.rules import edit, listed, normalize, parse_file, profile_name, profile_names, profiles, resolve
from trailgrid.plans.scopes import drive_letters
from trailgrid.sources import files


def test_rules_of_a_query():
    assert parse(["Ledger .XLS>"]) == [[Rule("contains", "ledger"), Rule("suffix", ".xls")]]
    assert parse(["<a|<b>", "<>"]) == [[Rule("prefix", "a")], [Rule("exact", "b")], [Rule("all")]]
    assert parse(["   "]) == [[Rule("contains", "   ")]]
    assert parse([r"C:\ x"])


@pytest.mark.parametrize("text", ["", "|", "<", ">", 'a"', "a?", "a*", "a:b", "a\n"])
def test_bad_queries(text):
    with pytest.raises(ValueError):
        parse([text])


@given(st.lists(st.text("ab<>| C:\\", max_size=12), max_size=3))
def test_parser_never_gives_an_empty_group(inputs):
    try:
        assert all(parse(inputs))
    except ValueError:
        pass


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("c:/**/*.java", "c:/a/b/x.JAVA", "c:/a.jav"), ("a/**", "a/b/c", "a"), ("{x,y}?", "xz", "x"), ("[!a-c]d", "zd", "ad"), ("**/q", "q", "aq")],
)
def test_globs(glob, yes, no):
    assert re.search(to_regex(glob), yes) and not re.search(to_regex(glob), no)


def test_glob_errors():
    for glob in ("[a", "{a", "a}"):
        with pytest.raises(ValueError):
            to_regex(glob)


def test_rule_files():
    a = parse_file(r"C:\r\a.trail_rules", "# x\nDEFAULT RULE IS EXCLUDE\norder 5 include .\n")
    b = parse_file(r"C:\r\b.work.trail_rules", "EXCLUDE C:\\x\nEXCLUDE C:\\x")
    assert b.profile == "work" and a.profile is None and profiles([a, b])["work"] == [b.path]
    assert not resolve([a]).include_by_default and [m.pattern for m in resolve([a]).matchers] == ["c:/r"]
    assert len(resolve([a, b], "work").matchers) == 2
    with pytest.raises(ValueError):
        resolve([a], "none")
    with pytest.raises(ValueError):
        resolve([a, parse_file("C:/z.trail_rules", "DEFAULT RULE IS INCLUDE")])
    with pytest.raises(ValueError):
        resolve([parse_file("C:/z.trail_rules", "INCLUDE {GIT_ROOT}/docs")])
    with pytest.raises(ValueError):
        parse_file("C:/z.trail_rules", "HIDE x")
    assert edit(edit("A\n", "B"), "B") == "A\nB\n" and edit("A\nB\n", "A", remove=True) == "B\n"


def test_profiles_listings_and_repositories(tmp_path):
    assert profile_name(" Default ") is None and profile_name("") is None and profile_name(" work ") == "work"
    for bad in ("a.b", "a/b", "a:b", "a\x01"):
        with pytest.raises(ValueError):
            profile_name(bad)
    kept, hidden = parse_file("C:/r/a.trail_rules", "EXCLUDE C:\\x\nINCLUDE C:\\y\n"), parse_file("C:/$Recycle.Bin/9/b.trail_rules", "EXCLUDE C:\\z\n")
    assert [m.pattern for m in resolve([kept, hidden]).matchers] == ["c:/x", "c:/y"] and len(resolve([kept, hidden], ignore=[]).matchers) == 3
    assert listed([kept], include=True) == [("C:/r/a.trail_rules", 2, "INCLUDE C:\\y")] and len(listed([kept], text="c:\\")) == 2
    assert listed([kept], profile="work") == [] and profile_names([kept, parse_file("C:/r/b.home.trail_rules", "")]) == ["home"]
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "repo" / "rules").mkdir()
    (tmp_path / "repo" / "rules" / "a.trail_rules").write_text("INCLUDE {GIT_ROOT}/docs\n")
    (found,) = files.rule_files(str(tmp_path / "repo" / "rules"))
    assert resolve([found]).matchers[0].pattern == f"{tmp_path}/repo/docs".lower() and files.unknown([found, kept], [kept]) == [found]


def test_paths_and_drives():
    assert normalize(r"C:\A\..\b\.\C\\") == "c:/b/c" and normalize("C:\\") == "c:/"
    assert drive_letters("C,D;E Fc") == ["C", "D", "E", "F"] and drive_letters("*", ["Z"], [r"G:\a", "g:/b", "C:"]) == ["G", "C"]
    with pytest.raises(ValueError, match="position 1"):
        drive_letters("C1")
