import re
from dataclasses import replace

from noticeworks.functions import text as T
from noticeworks.profile import LATIN_TEST, ZH_TENDER

HAN = "本项目资金来源为财政资金出资比例为百分之百现对该项目进行公开说明欢迎参加"


def test_html_to_text_order(evaluate):
    got = evaluate(
        T.html_to_text,
        "<!-- <script>a</script> --><p>一 二</p><SCRIPT x>var a = '</p>';</ script >三<style>p{}</style>\n\n四&nbsp;",
        "<script>a</style>b</script>c",
        "a　  b\x1cc",
        "",
        None,
    )
    assert got == ["一 二 三 四&nbsp;", "c", "a b c", "", None]


def test_valid_content_boundaries(evaluate):
    def valid(v):
        return T.is_valid_content(v, replace(ZH_TENDER, code_chars=1000, script_chars=2000))

    def whole(v):
        return T.is_valid_content(v, ZH_TENDER)

    cases = [
        ("一" * 29, False), ("一" * 30, True), ("x" * 19, False),
        ("var a = 1; " + "一" * 29 + " " * 1000 + "一" * 100, False),
        ("var a = 1; " + "一" * 30, True),
        ("x" * 2000 + "一" * 100, False),
        ("x" * 1970 + "一" * 30, True), ("x" * 1971 + "一" * 30, False), (None, False), ("", False),
    ]
    assert evaluate(valid, *[c for c, _ in cases]) == [e for _, e in cases]
    assert evaluate(whole, "x" * 5000 + "一" * 30, "x" * 5000 + "一" * 29, "var a = 1; " + " " * 1000 + "一" * 30) == [True, False, True]


def plain_summary(text, profile):
    """Summary rule as a plain loop, for comparison."""
    parts = re.split(profile.sentence_break, text)
    if len(parts) <= 1:
        parts = [text[i:i + 200] for i in range(0, len(text), 200)]
    han = re.compile("[一-鿿]")
    kept, size = [], 0
    for part in parts:
        part = part.strip()
        if len(part) < 10 or re.search(profile.junk, part) or len(re.findall(profile.nav_words, part)) >= 3:
            continue
        if re.match(r"^[\w \-\.·|/、，,]+$", part) and len(part) < 30:
            continue
        if len(han.findall(part)) < 5:
            continue
        kept.append(part)
        size += len(part)
        if size > 300:
            break
    return " ".join(kept)[:500] or None


def test_summary_matches_plain_loop(evaluate):
    import noticeworks.profile as P

    profile = ZH_TENDER
    # Python has no \\p classes
    python_profile = P.replace(profile, junk=profile.junk.replace(P.WORD, r"\w").replace("(?U)", ""),
                               sentence_break=profile.sentence_break.replace("(?U)", ""))
    texts = [
        HAN + "。" + HAN + "；短句。首页 登录 注册，" + HAN,
        HAN * 30,
        HAN + "。 " + "甲乙丙丁戊己庚辛壬癸" + "。" + HAN * 4 + "！" + HAN * 8 + "？" + HAN,
        "版权所有" + HAN + "。function x() " + HAN + "。北京上海广东" + HAN + "。" + HAN,
        "abc. " * 40 + HAN,
        "没有句号",
        "甲乙丙丁戊己庚辛壬癸甲乙丙丁戊。",
    ]
    got = evaluate(lambda v: T.summary(v, profile), *texts)
    assert got == [plain_summary(t, python_profile) for t in texts]


def test_summary_cut(evaluate):
    long = "".join(HAN + "。" for _ in range(40))
    [got] = evaluate(lambda v: T.summary(v, ZH_TENDER), long)
    # stops with the sentence that passes 300 characters
    assert got.count("。") == 300 // (len(HAN) + 1) + 1


def test_latin_profile_summary(evaluate):
    [got] = evaluate(lambda v: T.summary(v, LATIN_TEST), "short. This is a longer sentence, of course! Another good sentence, too. ")
    # the last one is a fragment: under 30 characters, words and commas only
    assert got == "This is a longer sentence, of course!"


def test_strip_nul(evaluate):
    assert evaluate(T.strip_nul, "a\x00b", None) == ["ab", None]
