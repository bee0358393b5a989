"""Text as Spark columns: everything here is a Catalyst expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it, the CJK block, and a chapter number at the start.
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = r"[一-鿿]"
CHAPTER_NUMBER = r"^第[零一二三四五六七八九十百千0-9]+[章节回卷]"

#: Lines that the content cleaner drops.
REMOVE_LINES = (
    r"^.*(上一章|下一章|返回目录|加入书签|推荐本书|投推荐票).*$",
    r"^.*(手机阅读|手机版|移动版|客户端|下载APP|扫码).*$",
    r"^.*(Ctrl\s*\+?\s*[DF]|F5|F11|ALT\s*\+).*$",
    r"^.*(铅笔小说|23qb|笔趣阁|顶点小说|天籁小说|飘天文学).*$",
    r"^.*(www\..*\.(com|net|org|cn)).*$",
    r"^.*(记住本站|收藏本站|网址|域名|地址).*$",
    r"^[\s\.。…]{10,}$",
    r"^[A-Za-z0-9]{20,}$",
    r"^.*(最新章节|更新最快|最快更新).*$",
    r"^\s*$",
    r"^[，。！？…、；：''（）《》\[\]{}【】\-,.!?:;\"'()\s]+$",
)
#: What it removes within a line.
INLINE_REMOVE = (
    r"（本章未完[^）]*）",
    r"\(本章未完[^)]*\)",
    r"【[^】]*?(更新|首发|独家)[^】]*?】",
    r"\[[^\]]*?(更新|首发|独家)[^\]]*?\]",
    r"（温馨提示[^）]*）",
)
#: What goes from chapter titles, and what else goes from novel titles.
TITLE_REMOVE = (
    r"\s*[-–—]\s*(铅笔小说|23qb|笔趣阁|顶点|天籁|飘天文学|最新章节).*$",
    r"\s*[-–—]\s*(www\..*\.(com|net|org|cn)).*$",
    r"\s*[（(]\s*(求收藏|求推荐|求月票|求订阅|求打赏|第一更|第二更|第三更|补更|加更|爆发|求票|求鲜花|各种求)[^）)]*[）)]",
    r"\s*[（(]\s*本章未完[^）)]*[）)]",
    r"\s*[\[【].*?(求收藏|求推荐|求月票|求订阅|求票|各种求)[^\]】]*[\]】]",
)
NOVEL_TITLE_REMOVE = (
    r"\s*[-–—]\s*(免费|全文|全本|精校|无删减|无广告|txt下载|在线阅读).*$",
    r"\s*[（(][^）)]*?(免费|全文|全本|精校|txt|下载|完本|完结|首发|无广告|无删减)[^）)]*[）)]",
    r"\s*[\[【][^\]】]*?(免费|全文|全本|精校|txt|下载|完本|首发)[^\]】]*[\]】]",
    r"\s*[-–—]\s*.*?(小说|作品|著|书).*$",
    r"\s*作者[：:]\s*\S+",
)
#: Entities of a title, the ampersand last so that nothing is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Titles that are no chapter's.
BAD_TITLES = (
    "", "null", "undefined", "None", "错误", "Error", "出现错误", "404", "404 Not Found", "403 Forbidden", "500",
    "页面不存在", "找不到页面", "该页面不存在", "访问被拒绝", "请稍后重试", "系统繁忙", "服务不可用",
    "加入书签", "推荐本书", "投推荐票", "手机阅读", "返回目录", "上一章", "下一章", "全部章节", "下载APP", "手机版",
    "电脑版", "客户端", "扫码阅读", "安装APP", "阅读进度", "书签", "目录", "回目录", "回書目", "正在加载", "加载中",
    "Loading", "请稍候", "查看更多", "展开全部", "收起", "点击加载更多", "确认", "取消", "关闭", "返回",
)
BAD_TITLE_PARTS = (
    "出现错误", "错误页面", "404", "Not Found", "Forbidden", "502 Bad Gateway", "503 Service", "系统错误", "服务器内部错误",
    "淘宝", "天猫", "京东", "拼多多", "成人", "色情", "赌博", "博彩", "www.", "http://", "https://",
    "<script", "</script", "&lt;script", "function(", "javascript:", "{{", "}}", "{%",
    "加入书签", "推荐本书", "投推荐票", "手机阅读", "返回目录", "全部章节", "下载APP", "扫码阅读", "阅读进度", "点击加载",
)
BAD_TITLE_PATTERNS = (
    r"^\d{1,3}$",
    r"^(.)\1{4,}$",
    r"^[，。！？…、；：''（）《》\[\]【】\-_,.!?:;\"'()\s]+$",
    r"^&[a-z]+;$",
    r"^[^一-鿿぀-ゟ゠-ヿa-zA-Z0-9\s]{5,}$",
)
#: Fixed value: the marks that are trimmed from both ends of a chapter title.
TITLE_EDGES = "·…。.!！?？,，;；:：\""
#: The tags that stay in text shown as HTML.
SAFE_TAGS = ("br", "p", "b", "i", "em", "strong", "h1", "h2", "h3", "h4", "h5", "h6")
#: What a page of a challenge or a refusal says near its start.
BLOCK_MARKERS = (
    "captcha", "verify you are a human", "请完成安全验证", "access denied", "403 forbidden", "request blocked",
    "浏览器安全检查", "请启用javascript", "please enable javascript", "ddos", "cloudflare", "challenge-platform",
    "您的ip已被", "访问过于频繁", "too many requests",
)
#: Fixed value: strings that the translator leaves alone.
NOT_WORDS = r"^[\s\d\p{P}\p{S}]*$"


#: Where one character has over half of a text of five or more, it stands twice within three places; from six
#: tenths on, it stands three times within five.
CLOSE_TWINS = (r"(?s)(.).?\1", r"(?s)(.)(?:\1.{0,2}|.\1.?|..\1)\1")

#: Characters that make up about half of a text in Latin letters.
HALF = " aeiou"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def breaks_to_lines(text: Column) -> Column:
    return strip_tags(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"))


def safe_html(text: Column, tags: Sequence[str] = SAFE_TAGS) -> Column:
    return F.regexp_replace(text, rf"(?i)<(?!/?(?:{'|'.join(tags)})\b)[^>]*>", "")


def count_words(text: Column, tags: bool = True) -> Column:
    """CJK characters, and runs of Latin letters, outside tags."""
    plain = strip_tags(text) if tags else text
    counted = F.regexp_count(plain, F.lit(CJK)) + F.regexp_count(plain, F.lit("[a-zA-Z]+"))
    return F.coalesce(counted, F.lit(0))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def translatable(text: Column) -> Column:
    return has_cjk(text) & ~text.rlike(NOT_WORDS)


def mode_share(text: Column) -> Column:
    """The share of the commonest character: the longest run once all are in order."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.array_max(F.transform(runs, lambda r: F.length(r))) / F.length(text)


def repeats_itself(text: Column, most: float = 0.6) -> Column:
    """Whether one character makes up so great a share; one of over half is the median of all in order.

    Where neither ``HALF`` nor all other characters together have that share, no character has. If
    one makes up six tenths, some three characters in a row hold it twice: only texts that pass both
    tests are put in order.
    """
    if most > 0.5:
        size = F.length(text)
        others = F.length(F.translate(text, HALF, ""))
        middle = F.element_at(F.sort_array(F.split(text, "")), (F.floor(size / 2) + 1).cast("int"))
        share = (size - F.length(F.replace(text, middle, F.lit("")))) / size
        may = (size >= 5) & ((others >= size * most) | (size - others >= size * most)) & text.rlike(CLOSE_TWINS[most > 0.55])
        return F.coalesce(F.when(may, share >= most), F.lit(False))
    return F.coalesce(F.when(F.length(text) >= 5, mode_share(text) >= most), F.lit(False))


def clean_content(
    text: Column,
    remove_lines: Sequence[str] = (),
    inline_remove: Sequence[str] = (),
    min_line_length: int = 2,
    max_repeat_ratio: float = 0.6,
) -> Column:
    """Lines that carry text, cleaned, one below another. A null text gives an empty one."""
    # What may stand before and after a word needs no match of its own; a line without CJK meets no word that has some.
    bare = [re.sub(r"^\^\.\*(.*)\.\*\$$", r"\1", p, flags=re.S) for p in REMOVE_LINES]
    words = [p[1:-1].split("|") if re.fullmatch(r"\([^()]*\)", p) else [p] for p in bare]
    plain = [w for ws in words for w in ws if len(ws) == 1 or not re.search(CJK, w)]
    # Patterns of whole lines are tried at the start of a line only.
    whole_line = [p[1:-1] for p in plain if re.fullmatch(r"\^[^|]*\$", p)]
    within = [p for p in plain if p[1:-1] not in whole_line]
    drop, drop_within = ("|".join(f"(?:{p})" for p in ps) for ps in ((*bare, *remove_lines), (*within, *remove_lines)))
    drop_whole = f"^(?:{'|'.join(whole_line)})$"
    cut = "|".join(f"(?:{p})" for p in (*INLINE_REMOVE, *inline_remove))
    lines = F.transform(F.split(F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text), "\n"), strip)
    kept = F.filter(
        lines, lambda x: (F.length(x) >= max(1, min_line_length)) & ~F.when(x.rlike(CJK), x.rlike(drop)).otherwise(x.rlike(drop_whole) | x.rlike(drop_within)) & ~repeats_itself(x, max_repeat_ratio)
    )
    # All that is removed within a line by default has CJK too.
    marked = lambda x: x.rlike(CJK) if not inline_remove else F.lit(True)
    whole = F.filter(F.transform(kept, lambda x: F.when(marked(x), strip(F.regexp_replace(x, cut, ""))).otherwise(x)), lambda x: x != "")
    return F.coalesce(F.array_join(whole, "\n"), F.lit(""))


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """A function of a value that it names many times: the value is worked out once, and plans stay small."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _without(title: Column, patterns: Sequence[str]) -> Column:
    out = strip(title)
    for p in patterns:
        out = strip(F.regexp_replace(out, p, ""))
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, entity, char)
    return F.coalesce(F.nullif(strip(out), F.lit("")), strip(title), F.lit(""))


def clean_title(title: Column) -> Column:
    return _without(title, TITLE_REMOVE)


def clean_novel_title(title: Column) -> Column:
    return _without(title, (*TITLE_REMOVE, *NOVEL_TITLE_REMOVE))


def valid_title(title: Column) -> Column:
    """Whether it may be a chapter's title: 2 to 200 characters, no page furniture, and some letters."""
    return _once(strip(F.coalesce(title, F.lit(""))), _valid)


def _valid(text: Column) -> Column:
    ok = F.length(text).between(2, 200) & ~text.isin(*BAD_TITLES)
    low = F.lower(text)
    for part in BAD_TITLE_PARTS:
        ok = ok & ~low.contains(part.lower())
    for pattern in BAD_TITLE_PATTERNS:
        ok = ok & ~text.rlike(pattern)
    return ok & (text.rlike(CJK) | text.rlike("[a-zA-Z]{3,}") | text.rlike(CHAPTER_NUMBER))


def clean_chapter_title(title: Column) -> Column:
    bare = F.regexp_replace(clean_title(title), "<[^>]*>", "")
    return _once(F.btrim(bare, F.lit(TITLE_EDGES)), lambda t: F.when(valid_title(t), t).otherwise(F.lit("")))


def without_suffix(text: Column, separators: Sequence[str] = (" - ", "_", " | ", " – ", "-")) -> Column:
    """For one separator after another, what stands before its last occurrence."""
    for s in separators:
        text = F.regexp_replace(text, f"(?s)^(.*)\\Q{s}\\E.*$", "$1")
    return strip(text)


def paragraphs(text: Column) -> Column:
    parts = F.split(text, F.when(text.contains("\n\n"), F.lit("\n\n")).otherwise(F.lit("\n")))
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 3)


def apply_transform(value: Column, kind: str, param: str = "") -> Column:
    """A rule's transform: ``prefix``, ``suffix``, ``regex`` (unchanged if nothing matches), ``trim`` or ``lower``."""
    if kind == "prefix":
        return F.when(value.startswith(param), F.substr(value, F.lit(len(param) + 1))).otherwise(value)
    if kind == "suffix":
        return F.when(value.endswith(param), F.left(value, F.length(value) - len(param))).otherwise(value)
    if kind == "regex":
        return F.when(value.rlike(param), F.regexp_extract(value, param, min(1, re.compile(param).groups))).otherwise(value)
    if kind == "trim":
        return strip(value)
    if kind == "lower":
        return F.lower(value)
    raise ValueError(f"no transform is called {kind}")


def fill(pattern: Column, values: dict[str, Column]) -> Column:
    """``{key}`` in a pattern replaced by its value, an empty one if it is null."""
    for key, value in values.items():
        pattern = F.replace(pattern, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return pattern


def anchor(template: Column, values: dict[str, Column]) -> Column:
    """A filled template without left-over placeholders and dangling separators."""
    text = strip(F.regexp_replace(fill(template, values), r"\{[^}]*\}", ""))
    text = strip(F.regexp_replace(text, r"\s*[-–—|·]\s*$", ""))
    return strip(F.regexp_replace(text, r"^\s*[-–—|·]\s*", ""))


def page_template(url: Column) -> Column:
    """The last positive number among the underscored parts of a file name becomes ``{page}``."""
    folder = F.regexp_extract(url, r"^(.*/)?([^/]*?)(\.[A-Za-z]+)?$", 1)
    stem = F.regexp_extract(url, r"^(.*/)?([^/]*?)(\.[A-Za-z]+)?$", 2)
    tail = F.regexp_extract(url, r"^(.*/)?([^/]*?)(\.[A-Za-z]+)?$", 3)
    parts = F.split(stem, "_")
    at = F.array_max(F.transform(parts, lambda p, i: F.when(p.rlike("^[0-9]+$") & ~p.rlike("^0+$"), i)))
    named = F.array_join(F.transform(parts, lambda p, i: F.when(i == at, F.lit("{page}")).otherwise(p)), "_")
    return F.when((F.size(parts) > 1) & at.isNotNull(), F.concat(folder, named, tail))


def page_urls(url: Column, pages: Column) -> Column:
    """Page 1 has the plain address; the others carry their number."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(pages, F.lit(1))), lambda n: F.when(n == 1, url).otherwise(F.concat(url, F.lit("?page="), n.cast("string")))
    )


def host_of(url: Column) -> Column:
    """The host in lower case; an IPv6 address without its brackets, and no user's name."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    return F.lower(F.btrim(found, F.lit("[]")))


#: IPv4 networks that no public site is in, as first address and length of the prefix.
PRIVATE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _ipv4(host: Column) -> Column:
    """An address as a number; null if the host is none."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    return F.when(host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$") & ~host.endswith("."), number)


def public_url(url: Column) -> Column:
    """http or https, and no address of a private, loopback, link-local or reserved network."""
    host = host_of(url)
    four = _ipv4(F.regexp_replace(host, r"^::ffff:(?=[0-9.]+$)", ""))
    inside = F.lit(False)
    for network, length in PRIVATE_NETWORKS:
        first = sum(int(p) << s for p, s in zip(network.split("."), (24, 16, 8, 0), strict=True))
        inside = inside | four.between(first, first + (1 << (32 - length)) - 1)
    # unspecified, loopback, unique local, link-local, multicast and documentation addresses
    six = host.contains(":") & host.rlike(r"^(::1?$|f[cd]|fe[89ab]|ff|2001:0?db8:)")
    named = host.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)\.?$")
    return F.coalesce(url.rlike("^(?i)https?://") & (host != "") & ~named & ~six & ~F.coalesce(inside, F.lit(False)), F.lit(False))


def blocked(html: Column, markers: Sequence[str] = BLOCK_MARKERS) -> Column:
    """A page too short to be one, or with a marker of a challenge near its start."""
    head = F.lower(F.substring(html, 1, 2000))
    found = F.lit(False)
    for m in markers:
        found = found | head.contains(m.lower())
    return F.coalesce((F.length(html) < 100) | found, F.lit(True))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    start = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"), start,
        lambda kept, part: F.when(part == ".", kept).when(part == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.array_append(kept, part)),
    )
    slash = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(parts, "/"), slash)).otherwise(path)


def join_url(base: Column, url: Column) -> Column:
    """An address as a page at ``base`` means it: with its scheme and host, and the folder it is relative to."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    host = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    place, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    folder = F.when((path == "") & (host != ""), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)?", 1))
    return (
        F.when(base == "", url)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url == "", base)
        .when(url.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), url))
        .when(url.startswith("?"), F.concat(scheme, host, path, url))
        .when(url.startswith("/"), F.concat(scheme, host, without_dots(place), rest))
        .otherwise(F.concat(scheme, host, without_dots(F.concat(folder, place)), rest))
    )


#: Callers whose word about a forwarded address is taken.
TRUSTED_PROXIES = ("127.0.0.1", "::1", "localhost")


def client_address(peer: Column, forwarded: Column) -> Column:
    """Whose a request is: the first of the addresses that a trusted proxy forwards, if any, else the caller's own."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    return F.when(peer.isin(*TRUSTED_PROXIES) & (F.coalesce(forwarded, F.lit("")) != ""), first).otherwise(F.coalesce(F.nullif(peer, F.lit("")), F.lit("unknown")))


def host_and_port(host: Column, default: int = 80) -> tuple[Column, Column]:
    """A host header's name, in lower case, and its port."""
    name = F.lower(F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)", 1))
    return name, F.coalesce(F.nullif(F.regexp_extract(host, r":(\d+)$", 1), F.lit("")).cast("int"), F.lit(default))


def module_enabled(config: Column, page: str, module: str) -> Column:
    """Whether a site's JSON settings leave a part of a page on: it is unless it says otherwise."""
    return F.coalesce(F.get_json_object(config, f"$.{page}.{module}.enabled").cast("boolean"), F.lit(True))
