"""Which files are scanned: size, path, extension and binary content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keysift.operators.allow import is_allowed_path
from keysift.rules.pack import RulePack

MIB = 1024 * 1024
MAX_FILE_BYTES = 100 * MIB
MAX_IMAGE_BYTES = 500 * MIB

# What is never scanned.
SKIPPED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
                      ".zip", ".tar", ".gz", ".rar", ".exe", ".dll", ".so", ".dylib", ".ttf",
                      ".woff", ".woff2", ".eot", ".mp3", ".mp4", ".avi", ".mov")
SKIPPED_ENDINGS = ("package-lock.json", "yarn.lock", "Cargo.lock", ".min.js", ".min.css")
SKIPPED_IN_IMAGES = (".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".jpg", ".jpeg", ".png",
                     ".gif", ".pdf", ".zip", ".tar", ".gz")
SKIPPED_IN_COMMITS = ("jpg", "jpeg", "png", "gif", "pdf", "doc", "docx", "xls", "xlsx", "zip", "tar",
                      "gz", "exe", "dll", "so", "dylib")
BINARY_SAMPLE_BYTES = 1024
BINARY_SHARE = 0.3


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def extension(path: Column) -> Column:
    """Lower-cased ending of the last path element, with its dot; empty when it has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def is_scannable_path(path: Column) -> Column:
    return ~extension(path).isin(*SKIPPED_EXTENSIONS) & ~_any([path.endswith(e) for e in SKIPPED_ENDINGS])


def is_inside_git(path: Column) -> Column:
    return path.rlike(r"(^|/)\.git/")


def is_skipped_in_image(path: Column) -> Column:
    return extension(path).isin(*SKIPPED_IN_IMAGES)


def is_skipped_in_commit(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(SKIPPED_IN_COMMITS) + r")\z")


def has_nul(content: Column) -> Column:
    return F.contains(content, F.lit(bytearray(b"\0")))


def is_control_heavy(content: Column) -> Column:
    """More than three tenths of the first bytes are control characters."""
    sample = F.decode(F.substring(content, 1, BINARY_SAMPLE_BYTES), "ISO-8859-1")
    return F.regexp_count(sample, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) > BINARY_SHARE * F.length(sample)


def is_binary(content: Column) -> Column:
    return (F.octet_length(content) > 0) & (has_nul(content) | is_control_heavy(content))


def file_length(files: DataFrame, length: str = "length", content: str = "content") -> Column:
    """A file's length; where it is not known that of its content, and 0 without either, so that no file is lost for it."""
    told = F.col(length).cast("bigint")
    if content not in files.columns:
        return F.coalesce(told, F.lit(0).cast("bigint"))
    return F.coalesce(told, F.octet_length(content).cast("bigint"), F.lit(0).cast("bigint"))


def gate_files(files: DataFrame, path: str = "path", length: str = "length",
               max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files worth opening; the size test reaches the file reader.  A file of unknown length is judged by its content (see ``file_length``)."""
    name = slashes(F.coalesce(F.col(path), F.lit("")))
    return files.filter((file_length(files, length) <= max_bytes) & ~is_inside_git(name) & is_scannable_path(name))


def gate_paths(files: DataFrame, pack: RulePack, path: str = "path") -> DataFrame:
    """Files whose path no allowlist names; one without a path is kept."""
    return files.filter(~F.coalesce(is_allowed_path(slashes(F.col(path)), pack), F.lit(False)))


def gate_image_files(files: DataFrame, path: str = "path", length: str = "length",
                     max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    return files.filter((file_length(files, length) <= max_bytes) & ~F.coalesce(is_skipped_in_image(F.col(path)), F.lit(False)))


def gate_changed_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(~F.coalesce(is_skipped_in_commit(F.col(path)), F.lit(False)))


def slashes(path: Column) -> Column:
    """A path with forward slashes only, as patterns and reports expect."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def readable_text(content: Column) -> Column:
    """File bytes as text; bytes that are not UTF-8 become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))
