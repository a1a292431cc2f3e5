"""Identity of saved things: canonical URLs, sites, ids and content hashes, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Ids depend on them.
JUNK_PARAMS = """
from from_source from_spmid seid vd_source unique_k referrer refer ref ref_src ref_url hmsr hmpl hmcu hmkw hmci bbid ts timestamp
_trigger sharer_shareid sharer_sharetime scene click_id gclid fbclid msclkid igshid si feature app utm channel track_id xhsshare appuid
apptime utm_content
""".split()
JUNK_PREFIXES = ("utm_", "spm_", "share_", "from_", "hm_", "wx", "_hsenc", "_hsmi")

#: Site, label, hosts, pattern of the id in the path (its groups are joined by hyphens).
SITES = (
    ("zhihu", "知乎", ("zhihu.com", "zhuanlan.zhihu.com"), r"/(?:question/(\d+)/answer/(\d+)|p/(\d+)|pin/(\d+)|answer/(\d+))"),
    ("xiaohongshu", "小红书", ("xiaohongshu.com", "xhslink.com"), r"/(?:explore|discovery/item|item)/([0-9a-f]+)"),
    ("weibo", "微博", ("weibo.com", "m.weibo.cn"), r"/(?:detail|status)/(\w+)|/\d+/(\w+)$"),
    ("wechat", "微信公众号", ("mp.weixin.qq.com",), ""),
    ("juejin", "掘金", ("juejin.cn",), r"/post/(\d+)"),
    ("csdn", "CSDN", ("blog.csdn.net", "csdn.net"), r"/article/details/(\d+)"),
    ("jianshu", "简书", ("jianshu.com",), r"/p/(\w+)"),
    ("douban", "豆瓣", ("douban.com",), r"/(?:note|topic|status)/(\d+)"),
    ("segmentfault", "SegmentFault", ("segmentfault.com",), ""),
    ("reddit", "Reddit", ("reddit.com", "old.reddit.com"), r"/comments/(\w+)"),
    ("x", "X / Twitter", ("twitter.com", "x.com"), r"/status/(\d+)"),
    ("medium", "Medium", ("medium.com",), r"-([0-9a-f]{8,})$"),
    ("stackoverflow", "Stack Overflow", ("stackoverflow.com", "stackexchange.com"), r"/questions/(\d+)"),
    ("github", "GitHub", ("github.com",), ""),
    ("substack", "Substack", ("substack.com",), ""),
)
#: Video sites, patterns of the id in the URL.
VIDEOS = (
    ("youtube", r"(?:youtube\.com|youtube-nocookie\.com)/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})"),
    ("youtube", r"youtu\.be/([A-Za-z0-9_-]{11})"),
    ("youtube", r"youtube\.com/(?:shorts|embed|v|live)/([A-Za-z0-9_-]{11})"),
    ("bilibili", r"bilibili\.com/video/(BV[0-9A-Za-z]{10})"),
    ("bilibili", r"(?i)bilibili\.com/video/(av\d+)"),
    ("bilibili", r"(?i)bilibili\.com/bangumi/play/(ep\d+|ss\d+)"),
)
GENERIC = ("web", "网页 / Web")


def form_encode(text: Column) -> Column:
    """Percent-encoding of a query part: a space becomes +, letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(raw: Column) -> Column:
    """The parameters that are no junk, encoded anew, in their order."""

    def pair(p: Column) -> Column:
        cut = F.position(F.lit("="), p)
        key = F.when(cut > 0, F.substring(p, F.lit(1), cut - 1)).otherwise(p)
        value = F.when(cut > 0, F.substring(p, cut + 1, F.length(p))).otherwise("")
        plain = lambda c: F.coalesce(F.try_url_decode(c), c)
        return F.struct(plain(key).alias("k"), plain(value).alias("v"))

    def junk(k: Column) -> Column:
        out = F.lower(k).isin(JUNK_PARAMS)
        for p in JUNK_PREFIXES:
            out = out | F.startswith(F.lower(k), F.lit(p))
        return out

    pairs = F.filter(F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), pair), lambda x: ~junk(x["k"]))
    return F.array_join(F.transform(pairs, lambda x: F.concat(form_encode(x["k"]), F.lit("="), form_encode(x["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """One spelling for each page: https, lower-case host without www., no default port, no junk parameters, no
    fragment, no slash at the end. Blank or null gives an empty string."""
    given = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.contains(given, F.lit("://")), given).otherwise(F.concat(F.lit("https://"), given))
    part = lambda u, k: F.regexp_extract(u, r"(?s)^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)

    def build(u: Column) -> Column:
        net = F.lower(F.regexp_replace(part(u, 1), "^.*@", ""))
        host = F.regexp_replace(F.regexp_replace(net, ":[0-9]*$", ""), r"^www\.", "")
        port = F.regexp_extract(net, ":0*([1-9][0-9]*)$", 1)
        port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
        path = F.regexp_replace(part(u, 2), "/+$", "")
        query = _query(part(u, 3))
        return F.concat(F.lit("https://"), host, port, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    return F.when(given == "", "").otherwise(let(full, build))


def url_digest(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical.cast("binary")), 1, 16)


def _groups(text: Column, pattern: str) -> Column:
    n = pattern.count("(") - pattern.count("(?")
    return F.array_join(F.filter(F.array(*[F.regexp_extract(text, pattern, k + 1) for k in range(n)]), lambda g: g != ""), "-")


def identify(canonical: Column, sites: tuple = SITES, videos: tuple = VIDEOS) -> Column:
    """struct<source, source_id, media_kind> of a canonical URL: video sites first, then the site whose host is the
    longest suffix, else web. Without an id of the site's own the URL's digest is the id. sites and videos are tables like those above;
    a source of one's own is one more row."""

    def make(u: Column) -> Column:
        host = F.regexp_extract(u, "^https://([^/:?]*)", 1)
        path = F.regexp_extract(u, "^https://[^/?]*([^?]*)", 1)
        named = lambda s, i, k: F.struct(s.alias("source"), i.alias("source_id"), F.lit(k).alias("media_kind"))
        digest = url_digest(u)
        out = F.when(u == "", named(F.lit(""), F.lit(""), "post"))
        for site, pattern in videos:
            out = out.when(u.rlike(pattern), named(F.lit(site), F.regexp_extract(u, pattern, 1), "video"))
        for name, hosts, pattern in sorted(((n, h, p) for n, _, hs, p in sites for h in hs), key=lambda x: -len(x[1])):
            own = F.coalesce(F.nullif(_groups(path, pattern), F.lit("")), digest) if pattern else digest
            out = out.when((host == hosts) | F.endswith(host, F.lit("." + hosts)), named(F.lit(name), own, "post"))
        return out.otherwise(named(F.lit(GENERIC[0]), digest, "post"))

    return let(canonical, make)


def label_of(source: Column, sites: tuple = SITES) -> Column:
    names = {n: label for n, label, _, _ in sites} | dict([GENERIC])
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), source), source)


def item_id(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit(":"), source_id)


def chunk_id(item: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", item, ordinal.cast("string"), text).cast("binary")), 1, 20)


def content_hash(title: Column, author: Column, description: Column, folder: Column, tags: Column, duration: Column, body: Column | None = None) -> Column:
    """What an item's passages come from; body (a post's whole text) counts where it is not null and not empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat_ws("|", blank(title), blank(author), F.substring(blank(description), 1, 4000), blank(folder), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ","), F.coalesce(duration.cast("int"), F.lit(0)).cast("string"))
    if body is not None:
        head = F.when(blank(body) == "", head).otherwise(F.concat_ws("|", head, F.sha1(blank(body).cast("binary"))))
    return F.substring(F.sha1(head.cast("binary")), 1, 24)
