"""Size text, globs, paths, ids, names and URLs as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = (("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10))


def format_size(size: Column) -> Column:
    """Bytes as text: whole below 1 KB, else two decimals, ties to even; integers only, so no rounding of doubles."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for name, bits in reversed(UNITS):
        unit = F.lit(1 << bits).cast("long")
        hundred = size * F.lit(100)
        q = F.call_function("div", hundred, unit)
        r = F.pmod(hundred, unit) * 2
        q = q + F.when((r > unit) | ((r == unit) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)
        whole = F.call_function("div", q, F.lit(100).cast("long")).cast("string")
        text = F.concat(whole, F.lit("."), F.lpad(F.pmod(q, F.lit(100)).cast("string"), 2, "0"), F.lit(f" {name}"))
        out = F.when(size >= unit, text).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """``1.5 GB`` and the like in bytes (factors of 1024); null for anything else."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?B?)\s*$"
    upper = F.upper(text)
    number, unit = F.regexp_extract(upper, pattern, 1), F.regexp_extract(upper, pattern, 2)
    factor = F.lit(1).cast("long")
    for name, bits in UNITS:
        factor = F.when(unit.startswith(name[0]), F.lit(1 << bits).cast("long")).otherwise(factor)
    return F.when(number != "", F.floor(number.cast("double") * factor).cast("long"))


def glob_regex(pattern: str, cross: bool = True) -> str:
    """An anchored regular expression for a glob; with ``cross`` a star also matches slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += ".*" if cross else "[^/]*"
        elif c == "?":
            out += "." if cross else "[^/]"
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = re.sub(r"([\\\[&~|])", r"\\\1", pattern[k + 1 : end])
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "[":
            raise ValueError(f"unclosed class in {pattern!r}")
        else:
            out += re.escape(c)
        k += 1
    try:
        re.compile(out)
    except re.error as e:
        raise ValueError(f"bad class in {pattern!r}") from e
    return f"(?s)^(?:{out})$"


def matches_globs(path: Column, patterns: list[str], cross: bool = True) -> Column:
    """Whether a path matches any pattern, as it stands or below any directory; invalid patterns are skipped, no pattern matches all."""
    if not patterns:
        return F.lit(True)
    slashed = F.regexp_replace(path, r"\\", "/")
    found = F.lit(False)
    for p in patterns:
        p = p.replace("\\", "/")
        for one in (p, f"**/{p}"):
            try:
                found = found | slashed.rlike(glob_regex(one, cross))
            except ValueError:
                continue
    return found


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any component of a path matches: a directory that is excluded takes its subtree with it. Invalid patterns are skipped."""
    found = []
    for p in patterns:
        try:
            found.append(glob_regex(p).removeprefix("(?s)"))
        except ValueError:
            continue
    either = "|".join(found)
    return F.exists(F.split(path, "/"), lambda part: part.rlike(f"(?s){either}")) if found else F.lit(False)


def safe_symlink_target(target: Column) -> Column:
    """Relative, and without a parent step."""
    return target.isNotNull() & (target != "") & ~target.startswith("/") & ~F.array_contains(F.split(target, "/"), "..")


def sanitize_name(name: Column) -> Column:
    """Letters, digits, ``-``, ``_`` and ``.`` only; ``unnamed`` if nothing but dots up to two is left."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]", "")
    return F.when(clean.isNull() | clean.isin("", ".", ".."), "unnamed").otherwise(clean)


def hash_prefix(digest: Column) -> Column:
    """The directory of a chunk: its first two digits, 00 for shorter names."""
    return F.when(F.length(digest) < 2, "00").otherwise(F.substring(digest, 1, 2))


def hash_rest(digest: Column) -> Column:
    return F.when(F.length(digest) < 2, digest).otherwise(F.substring(digest, 3, 1 << 20))


def pack_name(pack_id: Column) -> Column:
    return F.concat(F.lit("pack-"), F.when(F.length(pack_id.cast("string")) >= 6, pack_id.cast("string")).otherwise(F.lpad(pack_id.cast("string"), 6, "0")), F.lit(".pack"))


def short_id(snapshot_id: Column) -> Column:
    return F.substring(snapshot_id, 1, 12)


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``; unchanged where it isn't below it."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 20)).otherwise(path)


def rebase_path(path: Column, mount: str, root: str = "/") -> Column:
    """The place of ``path`` (below ``root``) under a mounted copy."""
    return F.concat(F.lit(mount.rstrip("/") + "/"), F.regexp_replace(relative_path(path, root), "^/+", ""))


def parse_backend_url(url: Column) -> Column:
    """struct(kind, host, port, path, error) of a storage address: bare path, file, s3, sftp or webdav."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/:]+)", 1)
    port = F.regexp_extract(rest, r"^[^/:]+:([0-9]+)", 1)
    path = F.regexp_replace(rest, r"^[^/]*/?", "")
    net = scheme.isin("s3", "sftp", "webdav")
    kind = F.when((url == "") | url.isNull(), F.lit(None)).when(scheme == "", "file").when(scheme.isin("file", "s3", "sftp", "webdav"), scheme)
    return F.struct(
        kind.alias("kind"),
        F.when(net, host).alias("host"),
        F.when(net & (port != ""), port.cast("int")).when(scheme == "sftp", 22).alias("port"),
        F.when(kind.isNull(), F.lit(None)).when(net, path).otherwise(rest).alias("path"),
        kind.isNull().alias("error"),
    )


def file_hash(chunk_hashes: Column) -> Column:
    """Commitment to a file: the hash of its chunk hashes in order."""
    return F.sha2(F.array_join(chunk_hashes, "").cast("binary"), 256)
