"""Text functions as Spark columns: trimming, normalising, headings, times, media types, addresses, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and names of the service's contract.
SNIPPET_CHARS, ERROR_CHARS, QUESTION_CHARS = 500, 1000, 4000
EMPTY = "(empty)"
HTML_MARKERS = ("<!doctype html", "<html", "<head", "<body", "<article", "<main")
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm",
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "ogg": "audio/ogg", "flac": "audio/flac",
    "txt": "text/plain", "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DOCUMENT_TYPES = (
    "text/plain", "application/pdf", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
)
SIZE_LIMITS = {"image": 10 << 20, "video": 20 << 20, "audio": 25 << 20}

#: The headings of plain text: a roman numeral with its dot, # marks before one line, chapter words, a roman numeral with a title in capitals; and a section line.
ROMAN_LINE = r"^[IVXLCDM]+\.$"
MARKED = r"(?s)^#{1,6}\s+[^\r\n]+$"
CHAPTER = r"(?iu)^(chapter|section|part)\s+[\p{L}\d]+(?:[.: —-].*)?$"
ROMAN_TITLE = r"^[IVXLCDM]+\. [A-Z][A-Z ’'—-]+$"
SECTION_LINE = r"(?i)^section\s+.*$"


def java_trim(c: Column) -> Column:
    """Strip every character up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only, as Unicode sees it."""
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}]")


def optional(c: Column) -> Column:
    """Blank becomes null, all else is trimmed."""
    return F.when(~is_blank(c), java_trim(c))


def normalise_block(c: Column) -> Column:
    """Text of an extracted block: one kind of line end, single blanks, no blanks at line ends, one empty line at most, ` | ` between cells."""
    c = F.regexp_replace(F.regexp_replace(c, "﻿", " "), r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[\p{Z}\t\x0B\f]+", " "), r" *\n *", "\n")
    return java_trim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r" *\| *", " | "))


def normalise_line(c: Column) -> Column:
    """Text of a word-processor block: all white space becomes single blanks."""
    return java_trim(F.regexp_replace(F.regexp_replace(c, "﻿", " "), r"[\p{Z}\s]+", " "))


def normalise_plain(c: Column) -> Column:
    """Plain text of a web page."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\x0B\f]+", " "), r" *\n *", "\n")
    return java_trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_html(content_type: Column, body: Column) -> Column:
    """The declared type decides, even a blank one; where it is null, the first 512 characters are searched for a marker."""
    start = F.lower(F.ltrim(F.substring(body, 1, 512)))
    sniffed = F.lit(False)
    for m in HTML_MARKERS:
        sniffed = sniffed | F.contains(start, F.lit(m))
    return F.when(content_type.isNull(), F.coalesce(sniffed, F.lit(False))).otherwise(F.lower(content_type).isin("text/html", "application/xhtml+xml"))


def decode_bytes(body: Column, charset: Column) -> Column:
    """Decode by the charset, else by the byte order mark, else as UTF-8; a mark that fits the charset goes."""
    lead = F.hex(F.substring(body, 1, 3))
    wide = lead.startswith("FFFE") | lead.startswith("FEFF")
    name = F.coalesce(F.upper(charset), F.when(lead.startswith("FFFE"), "UTF-16LE").when(lead.startswith("FEFF"), "UTF-16BE").otherwise("UTF-8"))
    skip = F.when((name == "UTF-8") & lead.startswith("EFBBBF"), 3).when(name.isin("UTF-16LE", "UTF-16BE") & wide, 2).otherwise(0)
    rest = F.substring(body, skip + 1, F.octet_length(body))
    out = F.decode(rest, "UTF-8")
    for known in ("US-ASCII", "ISO-8859-1", "UTF-16LE", "UTF-16BE"):
        out = F.when(name == known, F.decode(rest, known)).otherwise(out)
    return out


def paragraphs(c: Column) -> Column:
    """Non-blank paragraphs of a text, trimmed. They are cut where two line ends of any kind have at most white space between them."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R\s*\R"), java_trim), lambda p: ~is_blank(p))


def is_heading(c: Column) -> Column:
    return F.coalesce(c.rlike(ROMAN_LINE) | c.rlike(MARKED) | c.rlike(CHAPTER) | c.rlike(ROMAN_TITLE), F.lit(False))


def heading_level(c: Column) -> Column:
    marks = F.length(F.regexp_extract(c, "^(#+)", 1))
    return F.when(marks > 0, F.least(marks, F.lit(6))).when(c.rlike(ROMAN_LINE) | c.rlike(SECTION_LINE), 2).otherwise(1)


def time_text(ms: Column) -> Column:
    """HH:mm:ss.SSS of milliseconds; hours may exceed two digits; null stays null."""
    ms = ms.cast("long")
    part = lambda by, mod=None: F.floor(ms / by) if mod is None else F.floor(ms / by) % mod
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", part(3_600_000), part(60_000, 60), part(1000, 60), ms % 1000))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def media_type(name: Column) -> Column:
    """Media type by extension; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), extension(name))


def media_error(name: Column, size: Column, kind: str) -> Column:
    """Why a file isn't a valid image, video or audio upload; null if it is."""
    return (
        F.when(is_blank(name), "file name is required")
        .when(F.coalesce(size, F.lit(0)) <= 0, "file is empty")
        .when(size > SIZE_LIMITS[kind], "file is too large")
        .when(~F.coalesce(media_type(name), F.lit("")).startswith(f"{kind}/"), "unsupported file type")
    )


def youtube_id(url: Column) -> Column:
    """Video id of an https address of a known host and path; null otherwise."""
    host = F.regexp_extract(url, r"^https://([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^https://[^/?#]+([^?#]*)", 1)
    long = host.isin("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com")
    found = F.when(host == "youtu.be", F.regexp_extract(path, r"^/([^/]+)/?$", 1)).when(long & (path == "/watch"), F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)).when(long, F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/]+)/?$", 1))
    return F.when(found.rlike(r"^[A-Za-z0-9_-]{11}$"), found)


def youtube_url(url: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id(url))


def url_error(url: Column) -> Column:
    """Why an address must not be fetched; null if it may be. Literal addresses of non-public ranges are refused, IPv6 ones that hold an IPv4 one too; names aren't looked up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":\d*$", ""))
    octet = lambda k: F.regexp_extract(host, r"^(?:\[(?:::|(?:0{1,4}:){5})ffff:)?(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\]?$", k).try_cast("int")
    wide = host.rlike(r"^\[(f[cdf][0-9a-f]{2}|fe[89a-f][0-9a-f]|2001:0?db8):|^\[[0:]*:0{0,3}[01]?\]$")  # local, link, site, many, written about; the loopback and none
    a, b, c = octet(1), octet(2), octet(3)
    private = (
        (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return (
        F.when(is_blank(url), "url is required")
        .when(~scheme.isin("http", "https"), "unsupported scheme")
        .when(authority == "", "host is required")
        .when(F.contains(authority, F.lit("@")), "user info is not allowed")
        .when((host == "localhost") | host.endswith(".localhost") | F.coalesce(private, F.lit(False)) | wide, "address is not public")
    )


def email_error(c: Column) -> Column:
    e = F.lower(java_trim(c))
    return F.when(is_blank(c), "email is required").when(F.length(e) > 320, "email is too long").when(~e.rlike(r"^[^@\s]+@[^@\s]+$"), "email is invalid")


def password_error(c: Column) -> Column:
    return F.when(is_blank(c), "password is required").when(F.length(c) < 12, "password is too short").when(F.octet_length(c) > 72, "password is too long")


def question_error(c: Column) -> Column:
    return F.when(is_blank(c), "question is required").when(F.length(java_trim(c)) > QUESTION_CHARS, "question is too long")


def media_range_error(start: Column, end: Column) -> Column:
    return F.when(start < 0, "start is negative").when(end.isNotNull() & start.isNull(), "end needs a start").when(end < start, "end is before start")


def fingerprint(c: Column) -> Column:
    """First 24 hexadecimal digits of the SHA-256, for audits."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 24)


def audit_token(c: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"[^A-Za-z0-9_.\-]", "_"), 1, most)


def location(start: Column, end: Column, page: Column, slide: Column, sheet: Column) -> Column:
    """Where a chunk stands: time before page before slide before sheet."""
    span = F.when(end.isNotNull(), F.concat(time_text(start), F.lit(" - "), time_text(end))).otherwise(time_text(start))
    return (
        F.when(start.isNotNull(), span)
        .when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string")))
        .when(slide.isNotNull(), F.concat(F.lit("slide "), slide.cast("string")))
        .when(~is_blank(sheet), F.concat(F.lit("sheet "), sheet))
        .otherwise(EMPTY)
    )


def sniffed_type(content: Column) -> Column:
    """Media type of a file's bytes by their first ones and, in archives and compound files, by the names inside; text if no byte is zero; null for the rest."""
    head = F.hex(F.substring(content, 1, 8))
    has = lambda name: F.contains(content, F.lit(name))
    office = F.when(has(b"word/"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(has(b"xl/"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").when(has(b"ppt/"), "application/vnd.openxmlformats-officedocument.presentationml.presentation").otherwise("application/zip")
    wide = lambda name: has(name.encode("utf-16-le"))
    compound = F.when(wide("WordDocument"), "application/msword").when(wide("Workbook"), "application/vnd.ms-excel").when(wide("PowerPoint Document"), "application/vnd.ms-powerpoint").otherwise("application/x-ole-storage")
    return (
        F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), office).when(head == "D0CF11E0A1B11AE1", compound)
        .when((F.octet_length(content) > 0) & ~has(b"\x00"), "text/plain")
    )


def document_error(content: Column, kind: Column, text: Column, locked: Column, failed: Column, most: int = 1_000_000) -> Column:
    """Code of the first thing wrong with a file: its bytes, its sniffed type, a password, a parser's failure, its length, its text; null if nothing is."""
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "EMPTY_DOCUMENT").when(~F.coalesce(kind.isin(*DOCUMENT_TYPES), F.lit(False)), "UNSUPPORTED_DOCUMENT_FORMAT")
        .when(locked, "PASSWORD_PROTECTED_DOCUMENT").when(failed, "CORRUPT_DOCUMENT").when(F.length(text) > most, "EXTRACTION_LIMIT_EXCEEDED").when(is_blank(text), "NO_EXTRACTABLE_TEXT")
    )


def length_prefixed_digest(parts: Sequence[Column]) -> Column:
    """SHA-256 over the parts, each after its length in bytes as four bytes; a null counts as length -1."""
    pieces = []
    for p in parts:
        size = F.when(p.isNull(), "FFFFFFFF").otherwise(F.lpad(F.hex(F.octet_length(p)), 8, "0"))
        pieces += [F.unhex(size), F.coalesce(p.cast("binary"), F.lit(b""))]
    return F.sha2(F.concat(*pieces), 256)


def error_text(message: Column, kind: Column) -> Column:
    """An error message of bounded length; the error's kind stands in for a blank one."""
    return F.substring(F.when(is_blank(message), kind).otherwise(message), 1, ERROR_CHARS)


def snippet(c: Column, most: int = SNIPPET_CHARS) -> Column:
    return F.substring(c, 1, most)


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
