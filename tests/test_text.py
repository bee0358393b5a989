import pytest
from pyspark.sql import functions as F

from storyloom.functions import numbers, text


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("title", "valid"),
    [("", False), ("12", False), ("ab", False), ("404页", False), ("上一章", False), ("第1章", True), ("Chapter 12", True), ("x" * 201, False), (None, False), ("aaaaa", False)],
)
def test_valid_title(spark, title, valid):
    assert one(spark, title, text.valid_title) is valid


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (text.count_words, "<p>Hello 世界 abc123</p>", 4),
        (text.count_words, None, 0),
        (text.clean_chapter_title, "第3章 开端（求月票）", "第3章 开端"),
        (text.safe_html, "<b>x</b><div>y", "<b>x</b>y"),
        (text.safe_html, "<H2>t</H2><p>a<br/><span>b</span><ul><li>c</li></ul><u>d</u>", "<H2>t</H2><p>a<br/>bcd"),
        (text.repeats_itself, "abacadaeaf", False),
        (text.repeats_itself, "abaacaadaa", True),
        (text.page_template, "https://h/book_7/list_2.html", "https://h/book_7/list_{page}.html"),
        (text.page_template, "https://h/book_7/list.html", None),
        (text.page_template, "https://h/3_a.html", "https://h/{page}_a.html"),
        (text.public_url, "http://[::1]/", False),
        (text.public_url, "http://[fd00::2]:80/x", False),
        (text.public_url, "http://[2606:4700::1111]/", True),
        (text.public_url, "http://198.18.0.1/", False),
        (text.public_url, "http://250.1.1.1/", False),
        (text.public_url, "http://172.31.0.9:8080/", False),
        (text.public_url, "http://172.32.0.9/", True),
        (text.public_url, "http://user@10.1.1.1/", False),
        (text.public_url, "http://10.example.com/", True),
        (text.public_url, "http://localhost:80", False),
        (text.repeats_itself, "aaab!", True),
        (text.repeats_itself, "aab", False),
        (text.repeats_itself, None, False),
        (text.breaks_to_lines, "a<BR />b<i>c</i>", "a\nbc"),
        (lambda c: text.without_suffix(c, (" - ",)), "a - b - c", "a - b"),
        (text.page_template, "https://h/book/postdate_0_0_0_0_0_0_0_3_0.html", "https://h/book/postdate_0_0_0_0_0_0_0_{page}_0.html"),
        (text.page_template, "https://h/book.html", None),
        (text.public_url, "ftp://x", False),
        (text.public_url, "http://10.0.0.1/", False),
        (text.public_url, "http://127.0.0.1", False),
        (text.public_url, "https://a.com", True),
        (lambda c: text.apply_transform(c, "regex", r"/book/(\d+)"), "/x/9", "/x/9"),
        (lambda c: text.apply_transform(c, "regex", r"/book/(\d+)"), "/book/3276/1.html", "3276"),
        (numbers.parse_magnitude, "1.5万字", 15000),
        (numbers.parse_magnitude, "9,999", 9),
        (lambda c: numbers.format_magnitude(c.cast("long")), "9999", "9,999"),
        (lambda c: numbers.format_magnitude(c.cast("long")), "12345", "1.2万"),
        (lambda c: text.anchor(F.lit("{title} - {author}"), {"title": c, "author": F.lit(None)}), "书", "书"),
        (text.clean_novel_title, "", ""),
        (text.translatable, "123。", False),
        (text.translatable, "你好", True),
    ],
)
def test_values(spark, function, given, wanted):
    assert one(spark, given, function) == wanted


def test_clean_content(spark):
    given = "第一章 测试\n\n上一章 返回目录\n真正的正文内容开始了，这里是小说正文。（本章未完，请翻页）\n。。。。。。。。。。。。\nabcdefghijklmnopqrstuvwxyz\n哈\n第二段正文继续。\r\n"
    assert one(spark, given, text.clean_content) == "第一章 测试\n真正的正文内容开始了，这里是小说正文。\n第二段正文继续。"
    assert one(spark, None, text.clean_content) == ""


def test_repeats_are_judged_on_whole_texts(spark):
    varied = "".join(map(chr, range(0x4E00, 0x4E00 + 250)))
    share = lambda c: text.repeats_itself(c, 0.15)
    assert one(spark, varied + "z" * 100, share) and not one(spark, varied + "z" * 10, share)
    assert not one(spark, "z" * 40 + varied, share)
    assert one(spark, "\n" * 15 + varied[:42] + "\U0001f642" * 43, lambda c: text.mode_share(c)) == 0.43
    assert not one(spark, "zzzz", share) and not one(spark, None, share)


def test_repeat_garbage_whole_takes_all_of_a_text(spark, tmp_path):
    from storyloom.plans import QUERIES

    varied = "".join(map(chr, range(0x4E00, 0x4E00 + 250)))
    rows = [(1, varied + "z" * 100), (2, "z" * 40 + varied)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, QUERIES["repeat_garbage_whole"](spark, str(tmp_path)).collect())) == {1: True, 2: False}


def test_block_pages_know_every_marker(spark, tmp_path):
    from storyloom.plans import QUERIES

    markers = [
        "captcha", "verify you are a human", "请完成安全验证", "access denied", "403 forbidden", "request blocked", "浏览器安全检查",
        "请启用javascript", "please enable javascript", "ddos", "cloudflare", "challenge-platform", "您的ip已被", "访问过于频繁", "too many requests",
    ]
    rows = [(k, "x" * 300 + m.upper()) for k, m in enumerate(markers)] + [(90, "x" * 300), (91, "x" * 2000 + "captcha"), (92, "x")]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = dict(map(tuple, QUERIES["block_pages"](spark, str(tmp_path)).collect()))
    assert [k for k, blocked in found.items() if not blocked] == [90, 91]
