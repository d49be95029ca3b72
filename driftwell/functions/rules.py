"""Path rules as columns.

Patterns are configuration, compiled on the driver into one regex each; paths are columns.  A null path gives null where
the result says something about the path, and false where a rule asks whether the path may be used.  Patterns come in
three dialects: shell patterns (``*`` crosses folders), ignore rules (``*`` stops at a slash, ``**`` does not), and the
host patterns of allow-lists.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest ignore rule that is compiled.
RULE_CHARS = 1024
#: Only "\n" ends a line, as in the dialects' own engine.
_FLAGS = "(?d)"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "/_ -" or c > "\x7f" else "\\" + c if c > " " else f"\\x{ord(c):02x}"


def _class(body: str, negated: bool) -> str:
    """A character class of single characters and ranges, each of them literal; ranges that run backwards hold nothing."""
    out, i = "", 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            lo, hi = body[i], body[i + 2]
            out += f"{_literal(lo)}-{_literal(hi)}" if lo <= hi else ""
            i += 3
        else:
            out += "\\-" if body[i] == "-" else _literal(body[i])
            i += 1
    return f"[^{out}]" if out and negated else f"[{out}]" if out else r"[\s\S]" if negated else "(?!)"


def _bracket(glob: str, i: int) -> tuple[str, int] | None:
    """The class that opens at ``i`` and the place behind it; null where it never closes.  A ``]`` that comes first is a member."""
    start = i + 1 + (glob[i + 1 : i + 2] == "!")
    end = glob.find("]", start + 1)
    return None if end < 0 else (_class(glob[start:end], start > i + 1), end + 1)


def _translated(glob: str, star: str, one: str, stars: str | None = None) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*" and stars and glob[i + 1 : i + 2] == "*":
            out, i = out + stars, i + 2 + (glob[i + 2 : i + 3] == "/")
        elif c == "[" and (found := _bracket(glob, i)):
            out, i = out + found[0], found[1]
        else:
            out, i = out + {"*": star, "?": one}.get(c, _literal(c)), i + 1
    return out


def fnmatch_regex(glob: str) -> str:
    """A shell pattern as a regex for whole strings; ``*`` and ``?`` take any character, slashes and newlines too."""
    return r"\A" + _translated(glob, r"[\s\S]*", r"[\s\S]") + r"\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether any shell pattern takes the path; false for no patterns, null for a null path."""
    return path.rlike("|".join(map(fnmatch_regex, globs))) if globs else F.when(path.isNotNull(), F.lit(False))


def ignore_regex(line: str) -> tuple[bool, bool, str] | None:
    """(negated, only for folders, regex) of an ignore rule; null for blanks, comments, over-long and empty rules.

    Group 1 of the regex is what stands behind the match.  A rule with a slash at its head is matched from the root,
    any other from the start of any folder or file name.  ``**/`` is any text, so it may end within a name.
    """
    line = line.rstrip()
    if not line or line[0] == "#" or len(line) > RULE_CHARS:
        return None
    negated, line = line[0] == "!", line.removeprefix("!")
    folder, line = line.endswith("/"), line.removesuffix("/")
    anchored, line = line.startswith("/"), line.removeprefix("/")
    if not line:
        return None
    head = r"\A" if anchored else r"\A(?:|.*/)"
    return negated, folder, _FLAGS + head + _translated(line, "[^/]*", "[^/]", ".*") + r"(/.*)?$"


def literal_runs(line: str) -> list[str]:
    """What every path that an ignore rule takes holds, once slashes stand at both ends of the path.

    A slash is added to a run that a name must start with; wildcards, and the slash that ``**`` takes, part runs.
    """
    line = line.rstrip().removeprefix("!").removesuffix("/")
    line = line if line.startswith("/") else "/" + line
    runs, i = [""], 0
    while i < len(line):
        if line[i] == "*":
            double = line[i + 1 : i + 2] == "*"
            i += 1 + double + (double and line[i + 2 : i + 3] == "/")
            runs.append("")
        elif line[i] == "?" or line[i] == "[" and _bracket(line, i):
            i = i + 1 if line[i] == "?" else _bracket(line, i)[1]
            runs.append("")
        else:
            runs[-1] += line[i]
            i += 1
    return [r for r in runs if r]


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that matches takes the path out; slashes at the path's head do not count.  Null paths: false.

    A rule for folders needs something behind the folder's name, as only files are asked about.
    """
    bare, out = F.ltrim(path, F.lit("/")), F.lit(False)
    for negated, folder, rx in filter(None, map(ignore_regex, lines)):
        hit = F.regexp_extract(bare, rx, 1) != "" if folder else bare.rlike(rx)
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def excluded(path: Column, globs: list[str], lines: list[str] = (), rules_file: str = ".driftignore") -> Column:
    """Whether a scan leaves the path out: the file of ignore rules itself, a pattern, anything below it, or an ignore rule.

    Two layers, one regex each for all patterns; null paths are left out.
    """
    below = reduce(or_, [path.startswith(f"{g}/") for g in globs], F.lit(False))
    return F.coalesce((path == rules_file) | matches_any(path, [g + tail for g in globs for tail in ("", "/*")]) | below | ignored(path, list(lines)), F.lit(True))


def in_scope(path: Column, folders: list[str], globs: list[str] = (), lines: list[str] = ()) -> Column:
    """Whether a remote file takes part: no leading underscore in its name, in none of the internal folders, not excluded."""
    inner = reduce(or_, [path.startswith(f"{f}/") for f in folders], F.lit(False))
    return F.coalesce(~base_name(path).startswith("_") & ~inner & ~excluded(path, list(globs), list(lines)), F.lit(False))


def selected(path: Column, wanted: list[str]) -> Column:
    """Whether the path is one of those asked for; all are where none is named."""
    return path.isin(list(wanted)) if wanted else F.lit(True)


def restore_match(path: Column, wanted: list[str]) -> Column:
    """Whether the path equals one of ``wanted`` or matches it as a shell pattern; all do where none is named."""
    return path.isin(list(wanted)) | matches_any(path, list(wanted)) if wanted else F.lit(True)


def below_folder(path: Column, folders: list[str]) -> Column:
    """Whether any component of the path is one of ``folders``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) if folders else F.lit(False)


def base_name(path: Column) -> Column:
    """What stands behind the last slash."""
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """Forward slashes only, none at the ends, none doubled; a null path is the empty one."""
    slashes = F.regexp_replace(F.coalesce(path, F.lit("")), r"[\\/]+", "/")
    return F.btrim(slashes, F.lit("/"))


def path_parts(path: Column) -> Column:
    """The components, empty ones dropped; a backslash is a character like others.  Null for a null path or one with a NUL."""
    return F.when(~path.contains("\0"), F.filter(F.split(path, "/"), lambda x: x != ""))


def contained_path(root: str, path: Column) -> Column:
    """``path`` below ``root`` with ``.`` and ``..`` resolved; null where it is absolute or leads out of the root, or holds a NUL."""
    stack = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda at, x: F.when(x.isin("", "."), at).when((x == "..") & ((F.size(at) == 0) | (F.element_at(at, -1) == "..")), F.concat(at, F.array(x)))
        .when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x))),
    )
    inside = ~path.contains("\0") & ~path.startswith("/") & ~F.array_contains(stack, "..")
    return F.when(inside, F.array_join(F.concat(F.array(F.lit(root.rstrip("/"))), stack), "/"))


def safe_path(path: Column) -> Column:
    """Whether a stored path may be used: not empty, no NUL, no slash or backslash at its head, no ``..``; false for null."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.coalesce((path != "") & ~path.contains("\0") & ~path.startswith("/") & ~path.startswith("\\") & ~F.array_contains(parts, ".."), F.lit(False))


def server_path(path: Column) -> Column:
    """``safe_path`` for paths that a server names, which may have no drive letter either."""
    return safe_path(path) & ~F.coalesce(path.rlike(r"\A[A-Za-z]:"), F.lit(False))


def shard(h: Column) -> Column:
    """Where a blob is stored: its hash below the hash's first two letters; null for null."""
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h)


def is_sha256(name: Column) -> Column:
    """Whether a name is 64 lower-case hexadecimal digits; false for null."""
    return F.coalesce(name.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """Whether a host is in the list, case aside; ``*.x`` takes hosts that end in ``.x`` with something before it.  False for null."""
    h = F.lower(host)

    def one(pattern: str) -> Column:
        p = pattern.lower()
        return h.endswith(p[1:]) & (F.length(h) > len(p) - 1) if p.startswith("*.") else h == p

    return F.coalesce(reduce(or_, map(one, allowed), F.lit(False)), F.lit(False))


#: Hosts of the providers' webhooks; the generic kind takes any.
WEBHOOK_HOSTS = {
    "slack": ["hooks.slack.com"],
    "discord": ["discord.com", "discordapp.com"],
    "teams": ["outlook.office.com", "*.webhook.office.com"],
    "webhook": None,
}


def webhook_allowed(url: Column, provider: str) -> Column:
    """Whether messages may be sent there: https, a host, and one that the provider has; an empty or null address is no address and passes."""
    host = F.lower(F.regexp_extract(url, r"(?i)\Ahttps://(?:[^/?#@]*@)?([^/?#@:]+)", 1))
    allowed = WEBHOOK_HOSTS[provider]
    return F.coalesce(url, F.lit("")).isin("") | ((host != "") & (F.lit(True) if allowed is None else host_allowed(host, allowed)))
