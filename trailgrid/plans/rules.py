"""Ordered include and exclude rules: files, profiles, and one column that says what is filtered out."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailgrid.functions.globs import has_meta, to_regex
from trailgrid.functions.paths import normalized

EXTENSION = ".trail_rules"
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Places whose rules files are ignored by default.
IGNORED = (
    "**/$RECYCLE.BIN/**", "**/AppData/Roaming/Code/User/History/**", "**/AppData/Roaming/Cursor/User/History/**",
    "**/AppData/Roaming/Windsurf/User/History/**", "**/.config/Code/User/History/**", "**/.config/Cursor/User/History/**",
    "**/.config/Windsurf/User/History/**", "**/.vscode/**/History/**", "**/CARGO_HOME/registry/src/**",
    "**/.cargo/registry/src/**", "**/cargo/registry/src/**",
)


@dataclass(frozen=True)
class RuleLine:
    """A line of a rules file; pattern is None for a default."""

    line: int
    include: bool
    pattern: str | None
    order: int | None
    raw: str


@dataclass
class RuleFile:
    """path, lines, and the directory that {GIT_ROOT} stands for, if there is one."""

    path: str
    lines: list[RuleLine]
    git_root: str | None = None

    @property
    def profile(self) -> str | None:
        """What follows the last dot of the name before the extension."""
        name = re.split(r"[/\\]", self.path)[-1].removesuffix(EXTENSION)
        return name.rpartition(".")[2] or None if "." in name else None


def parse_file(path: str, text: str, git_root: str | None = None) -> RuleFile:
    """Lines of a rules file; blank lines and comments are skipped."""
    lines = []
    for number, raw in enumerate(text.splitlines(), 1):
        raw = raw.strip()
        if not raw or raw.startswith("#"):
            continue
        if m := re.fullmatch(r"(?ai:DEFAULT RULE IS (INCLUDE|EXCLUDE))", raw):
            lines.append(RuleLine(number, m[1].upper() == "INCLUDE", None, None, raw))
        elif m := re.fullmatch(r"(?:(?ai:ORDER) ([+-]?\d+)\s+)?(?ai:(INCLUDE|EXCLUDE)) (\s*\S.*)", raw):
            lines.append(RuleLine(number, m[2].upper() == "INCLUDE", m[3].strip(), int(m[1]) if m[1] else None, raw))
        else:
            raise ValueError(f"{path}:{number}: unsupported rule syntax: {raw}")
    return RuleFile(path, lines, git_root)


def normalize(path: str) -> str:
    """The driver's form of :func:`trailgrid.functions.paths.normalized`."""
    slashed, out = path.replace("\\", "/"), []
    for part in slashed.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    text = "/" * slashed.startswith("/") + "/".join(out)
    return (text + "/" if re.fullmatch("[A-Za-z]:", text) else text).translate(_FOLD)


@dataclass(frozen=True)
class Matcher:
    """A rule with its place in the order: kind is subtree or glob."""

    order: int
    source: str
    line: int
    include: bool
    kind: str
    pattern: str

    def column(self, path: Column) -> Column:
        """Whether the rule matches a normalized path."""
        if self.kind == "glob":
            return path.rlike(to_regex(self.pattern))
        below = self.pattern if self.pattern.endswith("/") else self.pattern + "/"
        return (path == self.pattern) | F.startswith(path, F.lit(below))


@dataclass
class RuleSet:
    """Matchers in order, the default, and warnings about orders that several rules share."""

    matchers: list[Matcher] = field(default_factory=list)
    include_by_default: bool = True
    warnings: list[str] = field(default_factory=list)

    def filtered(self, path: Column) -> Column:
        """Whether a path is filtered out: the last matching rule decides, or else the default."""
        p = normalized(path)
        out = F.lit(not self.include_by_default)
        for m in self.matchers:
            out = F.when(m.column(p), F.lit(not m.include)).otherwise(out)
        return out

    def table(self, spark) -> DataFrame:
        """The rules as rows: rank, order, include, source_path, line_number, kind, pattern, regex (of globs)."""
        rows = [(i, m.order, m.include, m.source, m.line, m.kind, m.pattern, to_regex(m.pattern) if m.kind == "glob" else None) for i, m in enumerate(self.matchers)]
        return spark.createDataFrame(rows, "rank long, order long, include boolean, source_path string, line_number int, kind string, pattern string, regex string")


def applies(file: RuleFile, profile: str | None) -> bool:
    """Files without a profile hold for all; others for their own."""
    return file.profile is None or file.profile == profile


def ignored(path: str, globs: list[str]) -> bool:
    """Whether a rules file is to be ignored."""
    return any(re.search(to_regex(g), path.replace("\\", "/")) for g in globs)


def profile_name(text: str | None) -> str | None:
    """A profile's name as it stands in file names; None for the default one."""
    name = (text or "").strip()
    if name.lower() in ("", "default"):
        return None
    if "." in name:
        raise ValueError(f"{name!r}: a dot would begin another part of the file's name")
    if any(unicodedata.category(c) == "Cc" or c in "\\/:" for c in name):
        raise ValueError(f"{name!r}: no control characters, slashes or colons in a profile's name")
    return name


def resolve(files: list[RuleFile], profile: str | None = None, ignore: list[str] | tuple[str, ...] = IGNORED) -> RuleSet:
    """The rules of all files that apply, in the order (order, file, line), equal rules once."""
    profile = profile_name(profile)
    files = sorted((f for f in files if not ignored(f.path, list(ignore))), key=lambda f: f.path)
    if profile is not None and not any(f.profile == profile for f in files):
        raise ValueError(f"no rules file for profile {profile!r}")
    defaults: dict[bool, str] = {}
    found: list[Matcher] = []
    seen: set[tuple] = set()
    for f in (f for f in files if applies(f, profile)):
        for line in f.lines:
            if line.pattern is None:
                defaults.setdefault(line.include, f"{f.path}:{line.line}")
                continue
            pattern = absolute(line.pattern, f, line.line)
            text = normalize(pattern)
            kind = "glob" if has_meta(pattern) else "subtree"
            if kind == "glob":
                to_regex(text)
            order = line.order or 0
            if (order, line.include, kind, text) not in seen:
                seen.add((order, line.include, kind, text))
                found.append(Matcher(order, f.path, line.line, line.include, kind, text))
    if len(defaults) > 1:
        raise ValueError(f"conflicting default rules: {defaults[True]} and {defaults[False]}")
    found.sort(key=lambda m: (m.order, m.source, m.line))
    shared = [o for o, n in sorted(Counter(m.order for m in found).items()) if n > 1]
    return RuleSet(found, next(iter(defaults), True), [f"order {o} is shared by several rules" for o in shared])


def absolute(pattern: str, file: RuleFile, line: int) -> str:
    """A pattern with its placeholder filled in, and relative ones put under the file's directory."""
    if "{GIT_ROOT}" in pattern:
        if not file.git_root:
            raise ValueError(f"{file.path}:{line}: no repository for {{GIT_ROOT}}")
        pattern = pattern.replace("{GIT_ROOT}", file.git_root)
    if re.match(r"[A-Za-z]:|[/\\]", pattern):
        return pattern
    folder = re.split(r"[/\\](?=[^/\\]*$)", file.path)[0]
    return f"{folder}/{pattern}"


def last_match_join(paths: DataFrame, rules: DataFrame, default_include: bool = True) -> DataFrame:
    """The same decision for rules that are rows (:meth:`RuleSet.table`), subtrees and globs: each path keeps the last
    rule that matches it."""
    last = F.try_element_at(_hits("_rules", "_p"), F.lit(-1))["include"]
    return _with_rules(paths, rules).withColumn("is_filtered", ~F.coalesce(last, F.lit(default_include))).drop("_p", "_rules")


def files_matching(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, source_path: the rules files of which some rule matches a path, each once."""
    found = F.array_distinct(F.transform(_hits("_rules", "_p"), lambda r: r["source_path"]))
    return _with_rules(paths, rules).select("path", F.explode(found).alias("source_path"))


def _with_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths with their normalized form and all rules in order. Rules come from files that the driver has parsed line by
    line, so they are few and go to every path as one array."""
    below = F.when(F.endswith("pattern", F.lit("/")), F.col("pattern")).otherwise(F.concat("pattern", F.lit("/")))
    ordered = rules.agg(F.sort_array(F.collect_list(F.struct("rank", "include", "source_path", "pattern", below.alias("below"), "regex"))).alias("_rules"))
    return paths.withColumn("_p", normalized(F.col("path"))).join(F.broadcast(ordered))


def _hits(rules: str, path: str) -> Column:
    p = F.col(path)
    return F.filter(rules, lambda r: F.when(r["regex"].isNotNull(), F.rlike(p, r["regex"])).otherwise((p == r["pattern"]) | F.startswith(p, r["below"])))


def profiles(files: list[RuleFile]) -> dict[str, list[str]]:
    """Paths of the files of each profile; the default one is always there."""
    out: dict[str, list[str]] = {"default": []}
    for f in sorted(files, key=lambda f: f.path):
        out.setdefault(f.profile or "default", []).append(f.path)
    return out


def profile_names(files: list[RuleFile]) -> list[str]:
    """The names of all profiles that have files, in order."""
    return sorted({f.profile for f in files if f.profile})


def listed(files: list[RuleFile], include: bool | None = None, text: str = "", profile: str | None = None) -> list[tuple[str, int, str]]:
    """(file, line, rule) of all rules files, those of a directive, with a text in them, or of a profile alone."""
    return [
        (f.path, line.line, line.raw)
        for f in sorted(files, key=lambda f: f.path) if profile is None or f.profile == profile_name(profile)
        for line in f.lines if include in (None, line.include) and text.lower() in line.raw.lower()
    ]


def edit(text: str, raw: str, remove: bool = False) -> str:
    """Adds a rule line at the end, or takes out every line with exactly that text; doing it twice changes nothing."""
    lines = text.splitlines()
    same = [x for x in lines if x.strip() == raw]
    if remove:
        lines = [x for x in lines if x.strip() != raw]
    elif not same:
        lines.append(raw)
    return "\n".join(lines) + "\n" if lines else ""
