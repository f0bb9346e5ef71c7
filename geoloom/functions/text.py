"""Strings, URLs and labels as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"
#: Names of parameters whose value is a credential.
CREDENTIALS = (
    "sig", "se", "st", "sp", "sv", "sr", "skoid", "sktid", "skt", "ske", "sks", "skv",
    "token", "access_token", "id_token", "refresh_token", "api_key", "apikey", "key", "map_key", "password",
)
#: Schemes of authorisation, and feeds whose key is a segment of the path.
SCHEMES, FEEDS = ("bearer", "basic"), ("area", "country")
#: Query keys of signed links, and prefixes of such keys.
SIGNED_KEYS = ("sig", "signature", "skoid", "sktid", "skt", "ske", "sks", "skv", "awsaccesskeyid", "securitytoken", "sv", "ss", "srt", "sp", "se", "st", "spr", "sr")
SIGNED_PREFIXES = ("x-amz-", "x-goog-")
#: File-name stems that an operating system keeps for itself.
RESERVED = ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
BYTE_UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB")


#: Parts of addresses and headers as their standards have them: what a scheme and an authority begin with, characters that
#: end an address in running text, and the token of an authorisation header.
_SCHEME, _END, _TOKEN68 = r"[A-Za-z][\w+.-]*://", r"\s\"'<>", r"[\w.~+/-]+=*"


def _rules() -> list[tuple[str, str]]:
    """What is masked, in this order: pattern and replacement."""
    found = [(rf"({_SCHEME})[^{_END}/?#]*@", "$1")]
    for sign, before in (("?", "?#"), ("#", "#")):
        # Query, then fragment: all behind the sign, up to the next part.
        found.append((rf"({_SCHEME}[^{_END}{before}]*)\{sign}[^{_END}{'#' if sign == '?' else ''}]+", f"$1{sign}{MASK}"))
    # A feed's key stands between its format and what is asked for.
    found += [(rf"(?i)(?<=/api/{feed}/csv/)[^/{_END}?#]+", MASK) for feed in FEEDS]
    names = [*CREDENTIALS, r"x-amz-[a-z-]+"]
    found.append((rf"(?i)(?<![\w-])({'|'.join(names)})=[^&{_END}]+", f"$1={MASK}"))
    found += [(rf"(?i)(?<!\w)({scheme})\s+{_TOKEN68}", f"$1 {MASK}") for scheme in SCHEMES]
    return found


REDACTIONS = _rules()


def redacted(text: Column) -> Column:
    """text without user info, queries and fragments of addresses, keys in paths, and credentials; null stays null."""
    return reduce(lambda said, rule: F.regexp_replace(said, *rule), REDACTIONS, text)


def error_text(kind: Column, said: Column) -> Column:
    """A failure on one line, never empty and without credentials: its kind, and what it says if anything."""
    line = F.trim(F.regexp_replace(redacted(F.coalesce(said, F.lit(""))), r"\s+", " "))
    return F.when(line == "", kind).otherwise(F.concat(kind, F.lit(": "), line))


def is_signed(url: Column) -> Column:
    """Whether a link carries a signature that will lapse."""
    query = F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    return query.rlike(rf"(^|&)({'|'.join([*SIGNED_KEYS, *(f'{p}[^=&]*' for p in SIGNED_PREFIXES)])})=")


def without_controls(text: Column) -> Column:
    """text without escape sequences, controls (but line feeds and tabs) and marks that turn the direction of writing."""
    out = F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0B-\x1F\x7F-\x9F‎‏‪-‮⁦-⁩]", "")


COMPACT = 500


def compacted(text: Column, most: int = COMPACT) -> Column:
    """Head and tail of a long text about a note of what was left out; a text with such a note stays."""
    half = most // 2
    cut = F.concat(
        F.substring(text, 1, half),
        F.concat(F.lit("\n...["), (F.length(text) - most).cast("string"), F.lit(" characters compacted]...\n")),
        F.substring(text, -half, half),
    )
    known = text.rlike(r"\n\.\.\.\[\d+ characters compacted\]\.\.\.\n")
    return F.when((F.length(text) > most) & ~known, cut).otherwise(text)


def truncated(text: Column, most: int = 20_000) -> Column:
    over = F.length(text) - most
    marked = F.concat(F.substring(text, 1, most), F.lit("...[truncated "), over.cast("string"), F.lit(" characters]"))
    return F.when(over > 0, marked).otherwise(text)


def bytes_label(n: Column) -> Column:
    """A size in the largest unit of 1024 that is at least 1."""
    unit = reduce(lambda u, k: F.when(n >= 1024**k, k).otherwise(u), range(1, len(BYTE_UNITS)), F.lit(0))
    value = n / F.pow(F.lit(1024.0), unit)
    whole = F.format_string("%d", F.floor(value).cast("bigint"))
    shown = F.when(value == F.floor(value), whole).otherwise(F.format_string("%.1f", value))
    return F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, BYTE_UNITS)), unit + 1))


def tokens_label(n: Column) -> Column:
    """Three significant digits with K, M or B."""
    digits = F.length(n.cast("string"))
    factor = F.pow(F.lit(10.0), F.greatest(digits - 3, F.lit(0))).cast("bigint")
    # Half up at the third digit, in whole numbers.
    rounded = F.expr("0") + (F.floor((n * 2 + factor) / (factor * 2)).cast("bigint") * factor)
    rounded = F.when(digits <= 3, n).otherwise(rounded)

    def coefficient(unit: int) -> Column:
        whole, rest = F.floor(rounded / unit).cast("bigint"), F.pmod(rounded, F.lit(unit)).cast("bigint")
        one = F.concat(whole.cast("string"), F.lit("."), F.floor(rest / (unit // 10)).cast("bigint").cast("string"))
        two = F.concat(whole.cast("string"), F.lit("."), F.lpad(F.floor(rest / (unit // 100)).cast("bigint").cast("string"), 2, "0"))
        return F.when(whole >= 100, whole.cast("string")).when(whole >= 10, one).otherwise(two)

    out = F.when(rounded >= 10**9, F.concat(coefficient(10**9), F.lit("B")))
    out = out.when(rounded >= 10**6, F.concat(coefficient(10**6), F.lit("M")))
    out = out.when(rounded >= 1000, F.concat(coefficient(1000), F.lit("K"))).otherwise(rounded.cast("string"))
    return F.when(n <= 0, F.lit("0")).otherwise(out)


def index_id(source: Column, collection: Column, provider_id: Column) -> Column:
    """The stable id of a catalog entry: 20 hex digits of a digest of the three, set apart by a unit separator."""
    joined = F.concat(source, F.lit("\x1f"), collection, F.lit("\x1f"), provider_id)
    return F.concat(F.lit("sc_"), F.substring(F.sha2(joined, 256), 1, 20))


def token(text: Column) -> Column:
    """A name as it is compared: lower case, without hyphens, underscores and outer spaces."""
    return F.translate(F.lower(F.trim(text)), "-_", "")


#: Bytes of a file name, and what of them is kept for the scene's part; a digest that stands for what was cut.
NAME_BYTES, SCENE_BYTES, DIGEST = 240, 24, 8


def _safe(text: Column) -> Column:
    """text of letters, digits, dots, hyphens and underscores, without dots at its end; never empty."""
    kept = F.regexp_replace(F.regexp_replace(F.rtrim(text, F.lit(" .")), "[^A-Za-z0-9._-]+", "_"), "[ .]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("_"))


def _fitted(name: Column, of: Column, room: Column, kept: Column) -> Column:
    """name if it takes no more bytes than room; else its first `kept` characters (one at least) and a digest of `of`."""
    short = F.concat_ws("~", F.substring(name, F.lit(1), F.greatest(kept, F.lit(1))), F.substring(F.sha1(of), 1, DIGEST))
    return F.when(F.octet_length(name) <= room, name).otherwise(short)


def scene_filename(scene_id: Column, key: Column, suffix: Column, most: int = NAME_BYTES) -> Column:
    """`<id>_<key><suffix>` of safe characters in no more than `most` bytes.

    A suffix that the id ends with already is not said twice, unless it is `.bin` or all there is; a key that leaves the
    id under SCENE_BYTES, and then an id that is too long, are cut and marked by a digest; a name that an operating
    system keeps for itself gets an underscore in front."""
    dotted = F.when(suffix.startswith("."), suffix).otherwise(F.concat(F.lit("."), suffix))
    bare = F.left(scene_id, F.length(scene_id) - F.length(dotted))
    twice = F.lower(scene_id).endswith(F.lower(dotted)) & ~F.lower(dotted).isin(".bin") & (F.translate(bare, "._-", "") != "")
    behind = most - SCENE_BYTES - F.octet_length(dotted)
    tail = F.concat(F.lit("_"), _fitted(_safe(key), key, behind - 1, behind - DIGEST - 1), dotted)
    left = F.greatest(most - F.octet_length(tail), F.lit(1))
    name = F.concat(_fitted(_safe(F.when(twice, bare).otherwise(scene_id)), scene_id, left, left - DIGEST - 1), tail)
    return F.concat(F.when(F.upper(F.substring_index(name, ".", 1)).isin(RESERVED), "_").otherwise(""), name)


#: Endings by what a media type says, in order; endings of links that are kept; those about another ending.
MEDIA_SUFFIXES = (("jp2|jpeg2000", ".jp2"), ("tif", ".tif"), ("netcdf", ".nc"), ("hdf", ".hdf"), ("png", ".png"), ("jpeg|jpg", ".jpg"))
OTHER_NAMES = {".jpeg": ".jpg", ".tiff": ".tif"}


def asset_suffix(media_type: Column, href: Column, kept: list[str], packed: list[str], content_type: Column | None = None) -> Column:
    """A file's ending: of what was served, of its declared media type, or of the link's path; `.bin` if none is known.

    kept: endings of a path that are taken as they are; packed: endings that keep the one before them too."""
    def told(media: Column) -> Column:
        return reduce(lambda said, rule: said.when(F.lower(media).rlike(rule[0]), rule[1]), MEDIA_SUFFIXES[1:], F.when(F.lower(media).rlike(MEDIA_SUFFIXES[0][0]), MEDIA_SUFFIXES[0][1]))

    name = F.lower(F.substring_index(F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/", -1))
    last, inner = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1), F.regexp_extract(name, r"[^.](\.[^.]+)\.[^.]+$", 1)
    own = reduce(lambda said, pair: said.when(last == pair[0], pair[1]), OTHER_NAMES.items(), F.when(last == "", None))
    own = own.when(last.isin(kept), last).when(last.isin(packed), F.concat(inner, last))
    return F.coalesce(*([told(content_type)] if content_type is not None else []), told(media_type), own, F.lit(".bin"))
