"""URLs as Column expressions, for absolute http and https URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and names of parameters that are secret.
TRACKING = r"\.tsrc|guccounter|utm_source|utm_medium|utm_campaign|utm_term|utm_content"
SECRET = r"(?i)([?&](?:[^=&#]*[_-])?(?:api[_-]?key|auth|credential|password|secret|sig(?:nature)?|token)(?:[_-][^=&#]*)?=)[^&#]*"


def normalize_url(url: Column) -> Column:
    """Without fragment and tracking parameters; anything but an absolute http(s) URL stays as it is."""
    out = F.regexp_replace(url, "#.*$", "")
    out = F.regexp_replace(out, rf"([?&])(?:{TRACKING})(?:=[^&]*)?(?=&|$)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "&&+", "&"), r"\?&+", "?")
    return F.when(url.rlike("^https?://"), F.regexp_replace(out, "[?&]+$", "")).otherwise(url)


def safe_http_url(url: Column) -> Column:
    """The URL if it is absolute, http(s), without user or password and without control characters, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#@\s\x00-\x1f\x7f]+([/?#][^\x00-\x1f\x7f]*)?\z"), url)


def redact_url(url: Column) -> Column:
    """Without user and password, and with values of secret parameters masked."""
    bare = F.regexp_replace(url, r"^(https?://)[^/?#@]*@", "$1")
    return F.when(url.rlike(r"^https?://[^\x00-\x1f\x7f]+\z"), F.regexp_replace(bare, SECRET, "$1<redacted>")).otherwise(F.lit("<invalid-url>"))


def absolute_url(link: Column, base: Column) -> Column:
    """A link of a page, its entities decoded, as an absolute URL, with dot segments resolved; base is http or https."""
    from tidemill.functions.text import decode_entities

    link = F.trim(decode_entities(link))
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    own_path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    whole = F.when(link.startswith("/"), own_path).when(own_path == "", path).otherwise(F.concat(F.regexp_extract(path, r"^(.*/)", 1), own_path))
    step = lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.array_append(done, part))
    parts = F.split(whole, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    suffix = F.when((own_path == "") & ~rest.startswith("?"), F.concat(F.coalesce(query, F.lit("")), rest)).otherwise(rest)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), link)).otherwise(F.concat(origin, F.array_join(ended, "/"), suffix))


def video_id(text: Column) -> Column:
    """The id of a video page's URL in one of its shapes, or a bare id of 11 characters; null otherwise."""
    host = r"^(?:https?://)?(?:www\.|m\.|music\.)?"
    shapes = (r"youtube\.com/watch\?(?:[^#]*&)?v=", r"youtube\.com/(?:shorts|embed|live|v)/", r"youtu\.be/")
    tail = r"([A-Za-z0-9_-]{11})(?:[?&#/].*)?$"
    found = F.coalesce(*(F.nullif(F.regexp_extract(F.trim(text), host + s + tail, 1), F.lit("")) for s in shapes))
    return F.coalesce(found, F.when(F.trim(text).rlike(r"^[A-Za-z0-9_-]{11}$"), F.trim(text)))


def is_channel_id(text: Column) -> Column:
    return text.rlike(r"^UC[A-Za-z0-9_-]{22}$")
