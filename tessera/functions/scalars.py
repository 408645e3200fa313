"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def format_bytes(n: Column, digits: int = 1) -> Column:
    """B, KB, MB or GB with one decimal; GB with `digits`. Halves, which are exact here, are rounded up."""
    part = lambda by, d, unit: F.concat(fixed(n / by + 1e-12, d), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, part(1024.0, 1, " KB")).when(n < 1024**3, part(1024.0**2, 1, " MB")).otherwise(part(1024.0**3, digits, " GB"))


def format_microseconds(n: Column) -> Column:
    """us, ms or s with two decimals; halves that are exact are rounded up."""
    up = lambda by: F.when(n % (by // 8) == 0, F.lit(1e-9)).otherwise(F.lit(0.0))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit("us"))).when(n < 1_000_000, F.concat(fixed(n / 1e3 + up(1000), 2), F.lit("ms"))).otherwise(F.concat(fixed(n / 1e6 + up(1_000_000), 2), F.lit("s")))


def format_duration(seconds: Column) -> Column:
    """-- for none, else seconds, minutes and seconds, or hours and minutes."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNull() | (seconds <= 0) | (seconds == float("inf")), "--").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat_ws(" ", F.concat((s / 60).cast("long").cast("string"), F.lit("m")), F.concat((s % 60).cast("string"), F.lit("s")))).otherwise(F.concat_ws(" ", F.concat((s / 3600).cast("long").cast("string"), F.lit("h")), F.concat((s % 3600 / 60).cast("long").cast("string"), F.lit("m"))))


def rate(done: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))


def eta(total: Column, done: Column, per_second: Column) -> Column:
    return F.when(per_second > 0, (total - done) / per_second).otherwise(F.lit(0.0))


def pad_cell(text: Column, width: int) -> Column:
    return F.rpad(text, width, " ")


def truncate_cell(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("~"))).otherwise(text)


def sanitize_subject(subject: Column, width: int = 80) -> Column:
    """A subject as part of a file name: marks that file systems refuse go, white space becomes one underscore."""
    clean = F.regexp_replace(F.coalesce(subject, F.lit("no-subject")), r'[<>:"/\\|?*\x00-\x1f]', "")
    clean = F.substring(F.regexp_replace(F.trim(clean), r"\s+", "_"), 1, width)
    return F.when(clean == "", "no_subject").otherwise(clean)


def filename_timestamp(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit("unknown"))


def eml_filename(at: Column, subject: Column) -> Column:
    return F.concat(filename_timestamp(at), F.lit("_"), sanitize_subject(subject), F.lit(".eml"))


def mask_subject(subject: Column, reveal: bool = False) -> Column:
    if not reveal:
        return F.lit("HIDDEN")
    return truncate_cell(F.coalesce(F.nullif(subject, F.lit("")), F.lit("(no subject)")), 60)


def sanitize_segment(name: Column) -> Column:
    """A path segment: refused marks become underscores, two dots one, dots at the ends go; never empty."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.\.+", "."), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", "Unknown").otherwise(clean)


def normalize_path(path: Column) -> Column:
    """Forward slashes, trimmed, one slash in front. Normalise to NFC with udfs.nfc where names aren't ASCII."""
    clean = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))


def logical_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), name)


def parent_path(path: Column) -> Column:
    """What follows root:, a slash if that is nothing, or the path as it is."""
    after = F.regexp_extract(path, r"root:(.*)$", 1)
    return F.when(~path.contains("root:"), path).when(after == "", "/").otherwise(after)


def site_reference(url: Column) -> Column:
    """host or host:/path of a URL; what isn't one stays as it is."""
    host, path = F.regexp_extract(url, r"^https?://([^/?#]+)", 1), F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    return F.when(host == "", url).when(path == "", host).otherwise(F.concat(host, F.lit(":"), path))


def valid_segment(part: Column) -> Column:
    return ~(part.isin("", ".", "..") | part.rlike(r"[/\\\x00]"))


def chunk_timeout_ms(n: Column) -> Column:
    return F.greatest(F.lit(30000), F.ceil(n / 256)).cast("long")


def byte_ranges(n: Column, chunk: int = 4 * 1024 * 1024) -> Column:
    """Ranges (start, end included) that cover n bytes in chunks; the last may be short; none for no bytes."""
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + chunk - 1, n - 1).alias("end")))


def storage_path(n: Column) -> Column:
    return F.when(n >= 512 * 1024 * 1024, "large").otherwise("small")


def retry_delay_ms(attempt: Column, retry_after_ms: Column, base: int = 1000, cap: int = 300_000, jitter: int = 0) -> Column:
    return F.least(F.coalesce(retry_after_ms, (F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")) + jitter, F.lit(cap).cast("long"))


#: Codes and parts of texts of network errors.
NETWORK_CODES = ("ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "ENOTFOUND", "EPIPE", "EAI_AGAIN", "EHOSTUNREACH", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_SOCKET")
NETWORK_TEXTS = ("socket hang up", "network request failed", "econnreset", "etimedout", "fetch failed", "terminated", "aborted", "network error", "client network socket disconnected")


def retryable(status: Column, code: Column | None = None, message: Column | None = None) -> Column:
    """A transient status, or a network error by its code or by its text in any case."""
    out = F.coalesce(status.isin(429, 503, 504), F.lit(False))
    if code is not None:
        out |= F.coalesce(code.isin(*NETWORK_CODES), F.lit(False))
    if message is not None:
        low = F.lower(message)
        for part in NETWORK_TEXTS:
            out |= F.coalesce(low.contains(part), F.lit(False))
    return out


def version_unavailable(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(404, 410), F.lit(False)) | F.coalesce(message.rlike("404|Not Found|410"), F.lit(False))


def format_recipient(name: Column, address: Column) -> Column:
    address = F.coalesce(F.nullif(address, F.lit("")), F.lit("(unknown)"))
    return F.when((F.coalesce(name, F.lit("")) == "") | (name == address), address).otherwise(F.concat(name, F.lit(" <"), address, F.lit(">")))


def target_id(endpoint: Column, region: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", endpoint, region).cast("binary"), 256), 1, 16)


def content_md5(data: Column) -> Column:
    return F.base64(F.unhex(F.md5(data)))


def upload_chunks(n: Column, threshold: int = 3 * 1024 * 1024, chunk: int = 13 * 320 * 1024) -> Column:
    """Ranges of an attachment's upload: one for a small one, chunks from the threshold on."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), (n - 1).cast("long").alias("end")))
    return F.when(n >= threshold, byte_ranges(n, chunk)).otherwise(whole)


def lock_mode(text: Column, default: str | None = None) -> Column:
    """GOVERNANCE or COMPLIANCE in upper case; the default for none; null for anything else."""
    up = F.upper(F.trim(text))
    return F.when(F.coalesce(up, F.lit("")) == "", F.lit(default)).when(up.isin("GOVERNANCE", "COMPLIANCE"), up)


def retention_days(text: Column) -> Column:
    """A positive whole number of days; null for anything else."""
    n = F.when(text.rlike(r"^\s*[0-9]+\s*$"), F.trim(text).try_cast("int"))
    return F.when(n > 0, n)


def retain_until(at: Column, days: Column) -> Column:
    """So many days of 86,400 seconds later."""
    return at + F.make_dt_interval(days.cast("int"))


def parse_date(text: Column) -> Column:
    """Midnight of YYYY-MM-DD; null for anything else."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd").cast("timestamp_ntz"))


def item_kind(has_file: Column, has_folder: Column, deleted: Column) -> Column:
    """Kind of a feed's item by its facets; a deleted item without any is a file."""
    return F.when(has_file, "file").when(has_folder, "folder").when(deleted, "file").otherwise("folder")


def first_errors(errors: Column, most: int = 10) -> tuple[Column, Column]:
    """The first errors of a list, and '... and N more' for the rest (null if there is none)."""
    more = F.size(errors) - most
    return F.slice(errors, 1, most), F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more")))
