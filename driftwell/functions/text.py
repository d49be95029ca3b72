"""Text, size and time functions as columns; null gives null where nothing else is said."""

from __future__ import annotations

import difflib
from functools import reduce
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(size: Column) -> Column:
    """Steps of 1024, one decimal, ties to even as in C; terabytes are the largest unit."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(size / 1024**k, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(size / 1024**4, 1)))


def parse_utc(text: Column) -> Column:
    """ISO 8601 date or time as a timestamp, without a zone taken as UTC (the session's zone must be); bad ones null."""
    return F.when(text.rlike(r"\A\d{4}-\d\d-\d\d(?:[T ]\d\d(?::?\d\d){0,2}(?:[.,]\d+)?(?:Z|[+-]\d\d(?::?\d\d)?)?)?\z"), F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T"))))


def snapshot_time(text: Column) -> Column:
    """Time of a snapshot's name (``2026-04-07T15-22-50Z``), else an ISO time, else the start of 1970, so that bad names count as old."""
    dashed = F.try_to_timestamp(F.regexp_replace(text, r"\A(\d{4}-\d\d-\d\d)T(\d\d)-(\d\d)-(\d\d)Z\z", "$1T$2:$3:$4Z"))
    return F.coalesce(dashed, parse_utc(text), F.lit("1970-01-01T00:00:00Z").cast("timestamp"))


def mount_time(text: Column, now: Column) -> Column:
    """Time of a snapshot's name; a bad one is ``now``, as times of files in a view only inform."""
    return F.coalesce(_name_time(text), now)


def _name_time(text: Column) -> Column:
    day = F.regexp_extract(text, r"\A(\d{4}-\d\d-\d\d)(?:[T ](\d\d)[-:](\d\d)[-:](\d\d))?Z*\z", 1)
    clock = [F.regexp_extract(text, r"\A(\d{4}-\d\d-\d\d)(?:[T ](\d\d)[-:](\d\d)[-:](\d\d))?Z*\z", k) for k in (2, 3, 4)]
    clock = [F.when(c == "", "00").otherwise(c) for c in clock]
    return F.when(day != "", F.try_to_timestamp(F.concat(day, F.lit("T"), F.array_join(F.array(*clock), ":"), F.lit("Z"))))


#: Days of a relative date's units.
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def parse_when(text: Column, now: Column) -> Column:
    """``30d``, ``2w``, ``3m`` or ``1y`` before ``now``, an ISO date, or an ISO time; anything else null.

    A time without a zone is in the session's zone, a date in UTC.
    """
    v = F.lower(F.trim(text))
    days = F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv]), F.right(v, F.lit(1)))
    ago = F.when(v.rlike(r"\A\d{1,6}[dwmy]\z"), now - F.make_dt_interval(F.try_multiply(F.regexp_extract(v, r"\d+", 0).cast("int"), days)))
    day = F.when(v.rlike(r"\A\d{4}-\d\d?-\d\d?\z"), F.try_to_timestamp(F.concat(v, F.lit("T00:00:00Z"))))
    return F.coalesce(ago, day, F.when(v.rlike(r"\A\d{4}-\d\d-\d\d[t ]"), parse_utc(F.upper(F.trim(text)))))


def age(ts: Column, now: Column) -> Column:
    """``just now`` (under a minute, or yet to come), else whole minutes, hours or days ago."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    steps = [(60, 3600, "m"), (3600, 86400, "h")]
    out = F.when(s < 60, "just now")
    for unit, below, mark in steps:
        out = out.when(s < below, F.concat(F.floor(s / unit).cast("string"), F.lit(f"{mark} ago")))
    return out.otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))


def valid_tag(tag: Column) -> Column:
    """1 to 64 letters, digits, dots, dashes and underscores; false for null."""
    return F.coalesce(tag.rlike(r"\A[A-Za-z0-9._-]{1,64}\z"), F.lit(False))


def valid_message(message: Column) -> Column:
    """At most 1024 characters; a null message is none and valid."""
    return F.coalesce(F.length(message) <= 1024, F.lit(True))


def message_cell(message: Column, width: int = 50) -> Column:
    """White space folded and the end cut to ``width`` with an ellipsis; a dash for none."""
    flat = F.btrim(F.regexp_replace(message, r"\s+", " "))
    cut = F.when(F.length(flat) <= width, flat).otherwise(F.concat(flat.substr(1, width - 1), F.lit("…")))
    return F.when(F.coalesce(message, F.lit("")) == "", "—").otherwise(cut)


def digests(content: Column) -> tuple[Column, Column]:
    """MD5 and SHA-256 of bytes or of a text's UTF-8."""
    return F.md5(content.cast("binary")), F.sha2(content.cast("binary"), 256)


def listing_size(size: Column) -> Column:
    """A listing's size as a number; missing, bad and negative ones are 0."""
    return F.greatest(F.coalesce(F.try_to_number(F.trim(size), F.lit("999999999999999999")).cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


#: Fixed value: how much of a file tells text from binary.
SNIFFED = 8192


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL or are no UTF-8 (a character cut at the end counts too); false for empty and null."""
    head = F.substring(content, 1, SNIFFED)
    return F.coalesce(F.contains(head, F.lit(b"\0")) | ~F.is_valid_utf8(head.cast("string")), F.lit(False))


def eligible(local: Column, remote: Column) -> Column:
    """Whether a conflict has two texts: both sides there, neither binary."""
    return local.isNotNull() & remote.isNotNull() & ~is_binary(local) & ~is_binary(remote)


def unified_diff(remote: Column, local: Column, path: Column) -> Column:
    """The diff from remote to local with three lines of context; empty for equal texts, null if one is null."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
        def one(x, y, name):
            if x is None or y is None:
                return None
            return "".join(difflib.unified_diff(x.splitlines(True), y.splitlines(True), f"remote/{name}", f"local/{name}"))

        return pd.Series([one(*r) for r in zip(a, b, p, strict=True)], dtype=object)

    return run(remote, local, path)


def line_changes(before: Column, after: Column) -> Column:
    """(added, removed): lines of a unified diff from ``before`` to ``after``; a null side has no lines."""

    @F.pandas_udf("added bigint, removed bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            ops = difflib.SequenceMatcher(None, (x or "").splitlines(), (y or "").splitlines()).get_opcodes()
            rows.append((sum(o[4] - o[3] for o in ops if o[0] in ("insert", "replace")), sum(o[2] - o[1] for o in ops if o[0] in ("delete", "replace"))))
        return pd.DataFrame(rows, columns=["added", "removed"])

    return run(before, after)


def redacted_error(message: Column, home: str = "", most: int = 160) -> Column:
    """An error's text without tokens, passwords in addresses, keys in queries, the home folder and NULs, cut to ``most``.

    Null is the empty text.
    """
    out = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?i)(Bearer|Token)\s+[A-Za-z0-9._\-]+", "$1 [redacted]")
    out = F.regexp_replace(out, r"(\b[a-z][a-z0-9+.\-]*://)[^/@\s]+:[^/@\s]+@", "$1[redacted]@")
    out = F.regexp_replace(out, r"(?i)([?&](?:access_token|token|api_key|key|secret|client_secret)=)[^&\s]+", "$1[redacted]")
    out = F.replace(out, F.lit(home), F.lit("/$HOME")) if home not in ("", "/") else out
    out = F.replace(out, F.lit("\0"), F.lit(""))
    return F.when(F.length(out) > most, F.concat(out.substr(1, most - 1), F.lit("…"))).otherwise(out)


#: Marks of the chat's own mark-up, and controls of direction and zero width, as characters of a regex class.
MARKUP = "*_~`<>&|"
DIRECTION = r"​-‏‪-‮⁠-⁤⁦-⁩﻿"


def chat_safe(text: Column) -> Column:
    """Without mark-up, control characters and controls of direction; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x00-\x1f\x7f{MARKUP}{DIRECTION}]", "")


def chat_action(text: Column) -> Column:
    """``chat_safe`` with bare addresses taken out."""
    return F.regexp_replace(chat_safe(text), r"(?i)\bhttps?://\S+", "[link removed]")


def shown_files(files: Column, most: int = 10) -> Column:
    """The first names, comma-separated, and how many more there are; empty for none."""
    names, n = F.coalesce(files, F.array().cast("array<string>")), F.coalesce(F.size(files), F.lit(0))
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(n > most, F.concat(F.lit(", and "), (n - most).cast("string"), F.lit(" more"))).otherwise(""))


def file_lines(files: Column, most: int = 10) -> Column:
    """The first names a line each with a dash, and how many more there are; ``(no files)`` for none."""
    names, n = F.coalesce(files, F.array().cast("array<string>")), F.coalesce(F.size(files), F.lit(0))
    more = F.when(n > most, F.concat(F.lit("\nand "), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n <= 0, "(no files)").otherwise(F.concat(F.array_join(F.transform(F.slice(names, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n"), more))


#: Colours of actions in messages, and that of all others.
COLOURS = {"push": "#22c55e", "pull": "#3b82f6", "sync": "#3b82f6", "delete": "#ef4444"}
OTHER_COLOUR = "#6b7280"


def colour(action: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), action), F.lit(OTHER_COLOUR))


def event_summary(user: str, machine: str, action: str, files: str, project: Column, ts: Column) -> Column:
    """One line that says who did what; ``no files`` where there are none."""
    names = F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise("no files")
    return F.concat(F.col(user), F.lit("@"), F.col(machine), F.lit(" "), F.col(action), F.lit("ed ["), names, F.lit("] in '"), project, F.lit("' at "), ts)


def template_vars(files: Column, **others: Column) -> dict[str, Column]:
    """The nine names a template may use; what is not given is empty, a snapshot's time ``unknown``."""
    first = F.when(F.size(files) > 0, F.element_at(files, 1)).otherwise("")
    empty = {k: F.lit("") for k in ("user", "machine", "project", "action", "timestamp")}
    return empty | others | {
        "n_files": F.coalesce(F.size(files), F.lit(0)).cast("string"), "file_list": shown_files(files), "first_file": first,
        "snapshot_timestamp": F.coalesce(others.get("snapshot_timestamp", F.lit(None).cast("string")), F.lit("unknown")),
    }


def rendered(template: str, names: dict[str, Column], fallback: Column) -> Column:
    """A template's text with ``{name}`` filled in; ``{{`` and ``}}`` are braces.

    An empty template, a name that is not there and braces out of order give the fallback.  Null values are ``None``.
    """
    from string import Formatter

    try:
        parts = list(Formatter().parse(template))
    except ValueError:
        return fallback
    if not template or any(name is not None and (name not in names or spec or conv) for _, name, spec, conv in parts):
        return fallback
    pieces = [x for text, name, _, _ in parts for x in ([F.lit(text)] if text else []) + ([F.coalesce(names[name], F.lit("None"))] if name is not None else [])]
    return F.concat(*pieces)


def rendered_all(templates: dict[str, object], names: dict[str, Column], fallback: Column) -> Column:
    """A map with every text of ``templates`` rendered and other values as JSON; empty ones, and any that fails, give the fallback for all."""
    import json

    missing = F.lit(None).cast("string")
    cells = {k: rendered(v, names, missing) if isinstance(v, str) and v else F.lit(v if isinstance(v, str) else json.dumps(v)) for k, v in templates.items()}
    if not cells:
        return fallback
    whole = F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in cells.values()]), whole).otherwise(fallback)


def project_slug(path: Column) -> Column:
    """A path as one file name: all but letters, digits and ``_.-~`` as percent escapes of the UTF-8."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None else quote(x, safe=""))

    return run(path)


def href_path(href: Column, base_url: str) -> Column:
    """A server's reference as a path below ``base_url``, percent escapes decoded, slashes at the ends off."""
    base = unquote(urlparse(base_url).path.rstrip("/"))

    @F.pandas_udf("string")
    def run(h: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            p = unquote((urlparse(x).path if x.startswith("http") else x).rstrip("/"))
            return (p[len(base) :] if p.startswith(base) else p).lstrip("/")

        return h.map(one)

    return run(href)


def envelope_name(path: Column) -> Column:
    """File name of a conflict's envelope; ``a/b`` and ``a__b`` share one."""
    return F.concat(F.replace(F.translate(path, "\\", "/"), F.lit("/"), F.lit("__")), F.lit(".merge.json"))


def state_name(kind: str, *key: Column) -> Column:
    """File name of stored state: its kind and the head of the SHA-256 over kind and key."""
    safe = "".join(c if c.isalnum() else "_" for c in kind)[:16]
    return F.concat(F.lit(f"{safe}_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *key), 256), 1, 32), F.lit(".json"))


def prompt_mark(ahead: Column, conflicts: Column, ascii_only: bool = False) -> Column:
    """The short text of a project's state for a prompt: in sync, or how many files are ahead and in conflict."""
    ok, up, bad = ("ok", "+", "!") if ascii_only else ("✓", "↑", "✗")
    counts = F.concat_ws(" ", F.when(ahead > 0, F.concat(F.lit(up), ahead.cast("string"))), F.when(conflicts > 0, F.concat(F.lit(bad), conflicts.cast("string"))))
    return F.when((ahead == 0) & (conflicts == 0), ok).otherwise(counts)


def list_line(line: Column) -> Column:
    """(name, kind, size) of a line of an FTP listing, Unix or DOS; null for blank and other lines, a link is its name alone."""
    unix = r"\A[-dl]\S*\s+\S+\s+\S+\s+\S+\s+(\S+)\s+\S+\s+\S+\s+\S+\s+([^\r\n]+?)[\r\n]*\z"
    dos = r"\A(?![-dl])\S+\s+\S+\s+(\S+)\s+([^\r\n]+?)[\r\n]*\z"
    folder = line.startswith("d")
    number = lambda rx: F.regexp_extract(line, rx, 1).try_cast("bigint")
    name = F.regexp_extract(line, unix, 2)
    as_unix = F.struct(
        F.when(folder, name).otherwise(F.substring_index(name, " -> ", 1)).alias("name"), F.when(folder, "dir").otherwise("file").alias("kind"), F.coalesce(number(unix), F.lit(0)).alias("size")
    )
    is_dir = F.upper(F.regexp_extract(line, dos, 1)) == "<DIR>"
    as_dos = F.struct(F.regexp_extract(line, dos, 2).alias("name"), F.when(is_dir, "dir").otherwise("file").alias("kind"), F.when(is_dir, 0).otherwise(number(dos)).cast("bigint").alias("size"))
    return F.when(line.rlike(unix), as_unix).when(line.rlike(dos) & (is_dir | number(dos).isNotNull()), as_dos)


#: Classes of errors by HTTP status; 5xx are transient, all others unknown.
ERROR_CLASSES = {401: "auth", 403: "permission", 400: "file_rejected", 404: "file_rejected", 413: "quota", 507: "quota", 408: "transient", 429: "rate_limit_global"}
RETRYABLE = ["transient", "unknown", "rate_limit_global"]
USER_ACTS = ["auth", "quota", "permission"]


def error_class(status: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ERROR_CLASSES.items() for x in kv]), status)
    return F.coalesce(known, F.when(status.between(500, 599), "transient"), F.lit("unknown"))


def mirror_state(error: Column) -> Column:
    """What an upload's outcome (an error class, null for none) makes of a file on a mirror."""
    return F.when(error.isNull(), "ok").when(error.isin(RETRYABLE), "pending_retry").otherwise("failed_perm")


def resolved(strategy: str, local: Column, remote: Column) -> Column:
    """(content, winner) under ``keep-local`` or ``keep-remote``."""
    sides = {"keep-local": (local, "local"), "keep-remote": (remote, "remote")}
    if strategy not in sides:
        raise ValueError(f"unknown strategy {strategy}")
    content, winner = sides[strategy]
    return F.struct(content.alias("content"), F.lit(winner).alias("winner"))


def conflict_markers(local: Column, remote: Column) -> Column:
    """Both texts between markers, white space at their ends off."""
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+\z", "")
    return F.concat(F.lit("<<<<<<< LOCAL\n"), bare(local), F.lit("\n=======\n"), bare(remote), F.lit("\n>>>>>>> REMOTE\n"))


_NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)\s*$"


def retry_after(*said: Column) -> Column:
    """Seconds that a server asks to wait, from the first of some texts that is a number, never below 0; null where none is.

    Dates are not read; what is no number says 0.
    """
    def one(text: Column) -> Column:
        return F.when(text.rlike(_NUMBER), F.greatest(F.lit(0.0), F.trim(text).try_cast("double"))).when(text.rlike(r"(?i)^\s*[+-]?nan\s*$"), 0.0)

    return F.coalesce(*[one(c) for c in said])


def hash_in_response(response: Column) -> Column:
    """The first word of a server's answer that is a digest (32 or more hexadecimal digits, colons around it aside), in lower case; null where none is.

    A status number at the head is passed over, with what parts it from the rest.
    """
    bare = F.regexp_replace(F.regexp_replace(response, r"^\s+", ""), r"^[0-9]{3}[ -]*", "")
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, "^:+|:+$", ""))
    return F.lower(F.get(F.filter(words, lambda w: w.rlike("^[0-9a-fA-F]{32,}$")), 0))


_VERSION = r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?(-\d+|[-_.]?(?:post|rev|r)[-_.]?\d*)?([-_.]?dev[-_.]?\d*)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"


def version_key(version: Column) -> Column:
    """A struct that sorts as versions do: epoch, numbers, then development, pre-, final and later releases, then local names; null for what is no version.

    Zeros at the end of the numbers do not count; numbers of over 18 digits make it null.
    """
    part = lambda i: F.regexp_extract(version, _VERSION, i)
    number = lambda text: F.coalesce(F.nullif(F.regexp_extract(text, r"(\d*)$", 1), F.lit("")), F.lit("0")).try_cast("bigint")
    pre, post, dev, local = F.lower(part(3)), part(5), part(6), F.lower(part(7))
    phase = F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3).when((post == "") & (dev != ""), 0).otherwise(4)
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("bigint"))
    names = F.transform(F.filter(F.split(local, "[-_.]"), lambda x: x != ""), lambda x: F.struct(x.rlike(r"^\d+$").alias("number"), F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")).otherwise(0).alias("n"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("name")))
    key = F.struct(
        F.coalesce(F.nullif(part(1), F.lit("")), F.lit("0")).try_cast("bigint").alias("epoch"), release.alias("release"), phase.alias("phase"), F.when(pre != "", number(part(4))).otherwise(0).alias("pre"),
        F.when(post != "", number(post)).otherwise(-1).alias("post"), F.when(dev == "", 1 << 62).otherwise(number(dev)).alias("dev"), names.alias("local"),
    )
    sound = version.rlike(_VERSION) & key["epoch"].isNotNull() & ~F.exists(release, lambda x: x.isNull()) & key["pre"].isNotNull() & key["post"].isNotNull() & key["dev"].isNotNull()
    return F.when(sound, key)


def strictly_newer(remote: Column, current: Column) -> Column:
    """Whether the remote version comes after the current one; false for no answer (empty or ``0.0.0``) and for what is no version."""
    asked = (F.coalesce(remote, F.lit("")) != "") & (remote != "0.0.0")
    return F.coalesce(asked & (version_key(remote) > version_key(current)), F.lit(False))


#: The sign of each state of a backend.
STATE_SIGNS = {"ok": "🟢", "pending": "🟡", "failed": "🔴"}


def backend_line(name: Column, state: Column, pushed: Column, pending: Column, error: Column) -> Column:
    """A backend's line in a chat message: its sign, and what was pushed, or the error and how many files wait; names and errors are made safe.

    An unknown state has a sign of its own, and is named where nothing else is known.
    """
    sign = F.coalesce(*[F.when(state == k, v) for k, v in STATE_SIGNS.items()], F.lit("⚪"))
    waits = F.coalesce(pending, F.lit(0))
    some = F.when(waits > 0, F.concat(waits.cast("string"), F.when(waits == 1, " file").otherwise(" files"), F.lit(" pending retry")))
    why = F.nullif(chat_safe(F.coalesce(error, F.lit(""))), F.lit(""))
    detail = F.coalesce(F.concat(why, F.lit(" ("), some, F.lit(")")), why, some, F.nullif(state, F.lit("")), F.lit("unknown"))
    said = F.when(state == "ok", F.concat(F.lit("pushed "), F.coalesce(pushed, F.lit(0)).cast("string"))).otherwise(detail)
    return F.concat(F.lit("• "), sign, F.lit(" "), chat_safe(name), F.lit(" — "), said)
