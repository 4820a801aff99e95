"""Sites with rules of their own: request headers, and links from their APIs.

Fixed values: the host tests, patterns, URL forms and header values below are what those sites need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_URL = r"^https?:\/\/truthsocial\.com\/api\/v1\/statuses\/\d+$"
POST_PAGE = r"^https?:\/\/truthsocial\.com\/@[A-Za-z0-9_]+\/posts\/"
POST_URL = POST_PAGE + r"(\d+)"
PROFILE_URL = r"^https?:\/\/truthsocial\.com\/@([^/]+)"
LOOKUP_URL = r"^https?://truthsocial\.com/api/v1/accounts/lookup\?acct=[a-zA-Z0-9]+$"
VIDEO_API = r"^https?:\/\/truthsocial\.com\/api\/v1\/truth\/videos\/[a-zA-Z0-9]+$"
STATUS_API = r"^https?:\/\/truthsocial\.com\/api\/v1\/statuses\/(\d+)"
ACCOUNT_API = r"^https?:\/\/truthsocial\.com\/api\/v1\/accounts\/([^/]+)"

PROFILES: dict[str, dict[str, str]] = {
    "npr": {
        "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
        "Accept-Language": "fr,fr-FR;q=0.8,en-US;q=0.5,en;q=0.3",
        "Referer": "https://www.npr.org/",
        "Connection": "keep-alive",
        "Upgrade-Insecure-Requests": "1",
        "Sec-Fetch-Dest": "document",
        "Sec-Fetch-Mode": "navigate",
        "Sec-Fetch-Site": "same-origin",
        "Sec-Fetch-User": "?1",
        "Priority": "u=0, i",
        "Pragma": "no-cache",
        "Cache-Control": "no-cache",
        "TE": "trailers",
    },
    "reddit": {"Cookie": "eu_cookie_v2=3; over18=1; _options=%7B%22pref_quarantine_optin%22%3A%20true%2C%20%22pref_gated_sr_optin%22%3A%20true%7D"},
    "tiktok": {
        "Authority": "www.tiktok.com",
        "Sec-Ch-Ua": '" Not A;Brand";v="99", "Chromium";v="99", "Microsoft Edge";v="99"',
        "Sec-Ch-Ua-Mobile": "?0",
        "Sec-Ch-Ua-Platform": '"Linux"',
        "Dnt": "1",
        "Upgrade-Insecure-Requests": "1",
        "User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/99.0.4844.74 Safari/537.36 Edg/99.0.1150.52",
        "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/webp,image/apng,*/*;q=0.8,application/signed-exchange;v=b3;q=0.9",
        "Sec-Fetch-Site": "none",
        "Sec-Fetch-Mode": "navigate",
        "Sec-Fetch-User": "?1",
        "Sec-Fetch-Dest": "document",
        "Accept-Language": "en-US,en;q=0.9,fr;q=0.8",
    },
    "status": {
        "User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:134.0) Gecko/20100101 Firefox/134.0",
        "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
        "Accept-Language": "en-US;q=0.5,en;q=0.3",
        "Accept-Encoding": "gzip, deflate, br, zstd",
        "Upgrade-Insecure-Requests": "1",
        "Sec-Fetch-Dest": "document",
        "Sec-Fetch-Mode": "navigate",
        "Sec-Fetch-Site": "none",
        "Sec-Fetch-User": "?1",
        "Connection": "keep-alive",
    },
    "account": {
        "User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:134.0) Gecko/20100101 Firefox/134.0",
        "Accept": "application/json, text/plain, */*",
        "Accept-Language": "en-US;q=0.5,en;q=0.3",
        "Accept-Encoding": "gzip, deflate, br, zstd",
        "Sec-Fetch-Dest": "empty",
        "Sec-Fetch-Mode": "cors",
        "Sec-Fetch-Site": "same-origin",
        "Connection": "keep-alive",
        "TE": "trailers",
    },
}


def profile(url: Column) -> Column:
    """Name of the first request profile that matches, or null."""
    return (
        F.when(url.contains("npr.org/"), "npr").when(url.contains("reddit.com"), "reddit").when(url.contains("tiktok.com/"), "tiktok")
        .when(url.rlike(VIDEO_API) | url.rlike(LOOKUP_URL) | url.rlike(STATUS_API), "status").when(url.rlike(ACCOUNT_API), "account")
    )


def request_headers(url: Column) -> Column:
    """Map of the extra headers of a URL's profile; empty without one."""
    found = F.create_map().cast("map<string,string>")
    for name, headers in reversed(PROFILES.items()):
        pairs = [F.lit(x) for kv in headers.items() for x in kv]
        found = F.when(profile(url) == name, F.create_map(*pairs)).otherwise(found)
    return found


def media_api(url: Column) -> Column:
    return url.contains("apipartner.ina.fr") & ~url.contains("playerConfigurations.json")


def media_assets(body: Column) -> Column:
    """Resource, thumbnail, player page and URI of a media description."""
    d = F.from_json(body, "resourceUrl string, resourceThumbnail string, embedUrl string, uri string")
    return F.array(d["resourceUrl"], d["resourceThumbnail"], F.concat(F.lit("https://player.ina.fr"), d["embedUrl"]), d["uri"])


def post_permalinks(body: Column) -> Column:
    """Both addresses of the first post of a listing; null without posts."""
    d = F.from_json(body, "data struct<children:array<struct<data:struct<permalink:string>>>>")
    link = F.get(d["data"]["children"], F.lit(0))["data"]["permalink"]
    return F.when(link.isNotNull(), F.array(F.concat(F.lit("https://www.reddit.com"), link), F.concat(F.lit("https://old.reddit.com"), link)))


def account_statuses(body: Column) -> Column:
    """Three status listings of an account."""
    base = F.concat(F.lit("https://truthsocial.com/api/v1/accounts/"), F.from_json(body, "id string")["id"], F.lit("/statuses?"))
    tails = ("exclude_replies=true&only_replies=false&with_muted=true", "pinned=true&only_replies=false&with_muted=true", "with_muted=true&only_media=true")
    return F.array(*[F.concat(base, F.lit(t)) for t in tails])


def status_videos(body: Column) -> Column:
    d = F.from_json(body, "media_attachments array<struct<external_video_id:string>>")
    ids = F.filter(F.transform(d["media_attachments"], lambda x: x["external_video_id"]), lambda x: x.isNotNull() & (x != ""))
    return F.transform(ids, lambda x: F.concat(F.lit("https://truthsocial.com/api/v1/truth/videos/"), x))


def post_status(url: Column) -> Column:
    """Status API address of a post page, or null."""
    found = F.regexp_extract(url, POST_URL, 1)
    return F.when(found != "", F.concat(F.lit("https://truthsocial.com/api/v1/statuses/"), found))


def embedded_post(url: Column) -> Column:
    """Address that shows a post of one site by itself, or null."""
    post = url.contains("www.facebook.com") & url.contains("/posts/") & ~url.contains("/plugins/post.php")
    return F.when(post, F.concat(F.lit("https://www.facebook.com/plugins/post.php?href="), F.url_encode(url), F.lit("&show_text=true")))


def repair_assets(links: DataFrame, page: str = "page_url") -> DataFrame:
    """Escaped ampersands in the assets of pages of one site are undone; what can't be decoded stays."""
    from dredge.functions.columns import unescape_ampersands

    return links.withColumn("url", F.when(F.col(page).contains("reddit.com"), unescape_ampersands(F.col("url"))).otherwise(F.col("url")))
