"""Extraction profiles: the label words, patterns and thresholds a notice corpus is read with.

``ZH_TENDER`` is the production profile.  ``LATIN_TEST`` keeps the same rules but
reads Latin-script pages, so the whole extraction can also run on corpora without
Chinese text.

All patterns are Java regular expressions.  They run on page text, whose only
white space is the single space, so ``\\s`` needs no Unicode mode; digits are
written out as ASCII or full width, which is much faster than Unicode classes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Letters, numbers and underscore in any script.
WORD = r"\p{L}\p{N}_"


@dataclass(frozen=True)
class Profile:
    name: str
    # class body of the script that marks real content
    script: str
    min_script: int
    min_sentence_script: int
    # listing pages
    min_anchors: int
    min_dated: int
    dated_always: int
    dated_ratio: float
    list_date: str
    # dates
    publish_hints: tuple[str, ...]
    bid_start_hints: tuple[str, ...]
    bid_end_hints: tuple[str, ...]
    date_patterns: tuple[str, ...]
    datetime_patterns: tuple[str, ...]
    # labelled fields
    bidder: str
    location: str
    location_names: str
    location_joiner: str
    amounts: tuple[str, ...]
    units: tuple[tuple[str, float], ...]
    phone: str
    mobile: str
    person: str
    contact_prefixes: tuple[str, str, str, str]
    # titles
    site_suffix: str
    generic_titles: tuple[str, ...]
    # summary
    sentence_break: str
    junk: str
    nav_words: str
    # notice types, in priority order
    notice_types: tuple[tuple[str, str], ...]
    # leading characters that a rule looks at; None: the whole text
    code_chars: int | None = None
    script_chars: int | None = None
    date_chars: int | None = None
    place_chars: int | None = None
    type_chars: int | None = None
    # smaller pages count as blocked; None: a page is judged by what it says
    min_page_chars: int | None = None


# ---------------------------------------------------------------------------
# Fixed values of the Chinese tender profile.
# ---------------------------------------------------------------------------
ZH_TENDER = Profile(
    name="zh_tender",
    script="一-鿿",
    min_script=30,
    min_sentence_script=5,
    min_anchors=8,
    min_dated=8,
    dated_always=15,
    dated_ratio=0.30,
    list_date=(
        r"(?:[0-9０-９]{4}\s*[-/.年]\s*[0-9０-９]{1,2}\s*[-/.月]\s*[0-9０-９]{1,2}\s*日?"
        r"|[0-9０-９]{1,2}\s*[-/.月]\s*[0-9０-９]{1,2}\s*日?)"
    ),
    publish_hints=(
        "发布时间", "发布日期", "公告日期", "公告时间", "发文日期", "发布于",
        "公示日期", "公示时间", "信息时间", "发布时间：", "日期",
    ),
    bid_start_hints=("投标开始", "报名开始", "报名时间", "获取招标文件时间"),
    bid_end_hints=("投标截止", "投标结束", "截止时间", "递交截止", "提交投标文件截止", "开标时间"),
    date_patterns=(
        r"([0-9０-９]{4})\s*年\s*([0-9０-９]{1,2})\s*月\s*([0-9０-９]{1,2})\s*日",
        r"([0-9０-９]{4})[-/]([0-9０-９]{1,2})[-/]([0-9０-９]{1,2})",
    ),
    datetime_patterns=(
        r"([0-9０-９]{4})\s*年\s*([0-9０-９]{1,2})\s*月\s*([0-9０-９]{1,2})\s*日\s*([0-9０-９]{1,2})\s*[:时]\s*([0-9０-９]{1,2})\s*分?",
        r"([0-9０-９]{4})[-/]([0-9０-９]{1,2})[-/]([0-9０-９]{1,2})\s+([0-9０-９]{1,2}):([0-9０-９]{1,2})",
        r"([0-9０-９]{4})\s*年\s*([0-9０-９]{1,2})\s*月\s*([0-9０-９]{1,2})\s*日",
        r"([0-9０-９]{4})[-/]([0-9０-９]{1,2})[-/]([0-9０-９]{1,2})",
    ),
    bidder=(
        r"(?:招标人|采购人|采购单位|招标单位|项目业主|建设单位|发包人|甲方)"
        r"\s*[:：]\s*(.{2,60}?)(?:[,，。\n\r<]|$)"
    ),
    location=(
        r"(?:项目地点|项目地址|工程地点|实施地点|交货地点|服务地点|地\s*点)"
        r"\s*[:：]\s*(.{2,80}?)(?:[,，。\n\r<;；]|$)"
    ),
    location_names=r"([一-鿿]{2,}(?:省|自治区|市|区|县|镇|乡|村|街道))",
    location_joiner="、",
    amounts=(
        r"(?:预算金额|采购预算|项目预算|预算|控制价|标段金额|总金额|合同金额|中标金额|中标价|成交金额|成交价)"
        r"\s*[:：]?\s*([0-9０-９,，.]+)\s*(万元|亿元|元)",
        r"([0-9０-９,，.]+)\s*(万元|亿元)",
    ),
    units=(("亿元", 100_000_000.0), ("万元", 10_000.0)),
    phone=(
        r"(?:联系电话|电\s*话|手\s*机|联系方式|联系人电话|咨询电话)"
        r"\s*[:：]?\s*([0-9０-９\s\-()（）+]{7,20})"
    ),
    mobile=r"1[3-9][0-9０-９]{9}",
    person=r"(?:联\s*系\s*人|项目联系人|采购联系人)\s*[:：]\s*([一-鿿]{2,4})",
    contact_prefixes=("联系人: ", "电话: ", "手机: ", "邮箱: "),
    site_suffix=(
        r"\s*[-_|｜·»]\s*(?:中国政府采购网|政府采购网|政采网|招标公告网|中国招标网|百度搜索|百度).*$"
    ),
    generic_titles=(
        "中国政府采购网", "政府采购信息网", "招标采购导航",
        "百度搜索", "bing", "google", "首页", "网站首页",
    ),
    # the first look-behind holds all characters a break comes after and skips all other places
    sentence_break=r"(?<=[。！？；\s])(?:(?<=[。！？；\n])\s*|(?<=[.;]\s))",
    # the look-ahead holds the first characters of the alternatives and skips all other places
    junk=(
        r"(?i)(?=[首网版关友设加免登欢退华东icarvfdwntj.$])"
        r"(?:首页|网站地图|版权所有|ICP备|Copyright|All Rights Reserved|"
        r"关于我们|友情链接|设为首页|加入收藏|免责声明|"
        r"登录\s*[\|｜]\s*注册|登录\s+注册|欢迎您|退出登录|"
        r"华北\s.*?华中|华东\s.*?华南|东北\s.*?西北|"
        rf"var\s+[{WORD}]+\s*=|function\s*[{WORD}]*\s*\(|document\.[{WORD}]|window\.[{WORD}]|"
        r"\.getElementById|\.createElement|\.innerHTML|new\s+XMLHttpRequest|"
        rf"\.addEventListener|console\.log|return\s+(?:true|false)|typeof\s+[{WORD}]|"
        r"\$\(|jQuery|\.css\(|\.ajax\(|\.ready\()"
    ),
    nav_words=r"登录|注册|分站|更多|首页|导航|北京|上海|广东|华北|华东|华南|东北|西北|华中|西南",
    notice_types=(
        ("中标", r"中标(公告|公示|结果|候选人|通知)|(成交|中选)(公告|公示|结果)|评标结果|定标(公告|结果|公示)"),
        ("变更公告", r"(变更|更正|澄清|修改|延期|补充)(公告|通知|说明)|(答疑|补遗)(公告|通知|文件)"),
        ("废标公告", r"(废标|流标|终止|失败|作废)(公告|公示|通知)|(采购|招标)(终止|中止|失败)"),
        ("采购意向", r"采购意向|(采购|需求)(计划|意向|预告)"),
        ("预招标", r"(预招标|资格预审|预审)(公告|通知|公示)|(征集|意向征询|市场调研)(公告|通知)"),
        ("合同", r"合同(公告|公示|签订|备案)|(签约|订立合同)(公告|公示)"),
        ("验收公告", r"(验收|履约)(公告|公示|结果|报告)|(结算|决算)(公告|公示)"),
        (
            "招标",
            r"招标(公告|通知|文件|邀请)|(竞争性磋商|竞争性谈判|询价|比选|竞价|邀标)(公告|通知)"
            r"|(采购|招标|比价|议价)(公告|通知|项目)|(公开招标|邀请招标|单一来源|竞价采购)",
        ),
    ),
)

# Latin-script variant with the same thresholds for content, lower ones for
# anchors (small pages) and English labels.
LATIN_TEST = replace(
    ZH_TENDER,
    name="latin_test",
    script=r"\p{L}",
    min_anchors=4,
    min_dated=4,
    dated_always=15,
    publish_hints=("Published", "Date"),
    bid_start_hints=("Opens",),
    bid_end_hints=("Closes",),
    bidder=r"(?:Buyer|Owner)\s*:\s*(.{2,60}?)(?:[,.\n\r<]|$)",
    location=r"(?:Place|Site)\s*:\s*(.{2,80}?)(?:[,.\n\r<;]|$)",
    location_names=r"([A-Z][a-z]{2,}(?:tion|edon|erin))",
    location_joiner=", ",
    amounts=(
        r"(?:Budget|Price)\s*:?\s*([0-9,.]+)\s*(million|thousand|EUR|USD)",
        r"([0-9,.]+)\s*(million|thousand)",
    ),
    units=(("million", 1_000_000.0), ("thousand", 1_000.0)),
    phone=r"(?:Phone|Tel)\s*:?\s*([0-9\s\-()+]{7,20})",
    mobile=r"[0-9０-９]{3}-[0-9０-９]{3}-[0-9０-９]{4}",
    person=r"(?:Contact)\s*:\s*(\p{L}{2,20})",
    contact_prefixes=("contact: ", "phone: ", "mobile: ", "email: "),
    sentence_break=r"(?<=[!?])\s*|(?<=\.\s)|(?<=;\s)",
    nav_words=r"login|register|more|home",
    notice_types=(
        ("award", r"(?i)\b(award|winner)\b"),
        ("change", r"(?i)\b(correction|amend\w*)\b"),
        ("tender", r"(?i)\b(the|der|les|los)\b"),
    ),
)

# Types that mark pages without business content.
LIST_PAGE = "list_page"
SEARCH_SERP = "search_serp"

PARSER_VERSION = "rule_v1"
