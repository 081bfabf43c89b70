"""Code pages from content alone, on texts the models were not learned from."""

import random

import pytest

from noticeworks.functions import charset as C
from noticeworks.functions import encoding as E

ZH = "采购项目名称为道路照明设备更新工程，预算金额一百二十万元。投标人须具有独立承担民事责任的能力，并在递交截止时间前完成注册。开标地点设在市公共资源交易中心三楼会议室，逾期送达的文件不予受理。"
HANT = "本院第三會議室將於下週舉行公開說明會，邀請各界專家學者參與討論。報名表請至網站下載，填妥後以傳真或電子郵件方式回覆，額滿為止。如有疑問歡迎來電洽詢承辦人員，謝謝您的支持與配合。"
JA = "東京都は来年度の予算案を発表しました。道路の改修や学校の建て替えに力を入れるとしています。詳しい内容はホームページをご覧ください。お問い合わせは総務課まで電話でお願いします。"
KO = "서울시는 내년도 예산안을 발표하였습니다. 도로 보수와 학교 시설 개선에 중점을 두겠다고 밝혔습니다. 자세한 내용은 누리집에서 확인하시기 바랍니다. 문의 사항은 총무과로 전화해 주십시오. "
RU = "Администрация города объявила конкурс на ремонт дорог и школьных зданий. Подробные сведения опубликованы на сайте. По всем вопросам обращайтесь в отдел закупок по телефону. "
WEST = "Die Bürger können während der Öffnungszeiten Anträge für Gebäude stellen. Les élèves ont été reçus à l'école après la fête. El niño comió una manzana mañana por la tarde según su mamá. "
TEXTS = {"gb18030": ZH, "big5": HANT, "shift_jis": JA, "euc_jp": JA, "euc_kr": KO, "cp1251": RU, "koi8_r": RU, "cp1252": WEST}


@pytest.mark.parametrize("name", TEXTS)
def test_pages_over_200_bytes_decode_right(name):
    rng, right, tried = random.Random(name), 0, 300
    for _ in range(tried):
        at, size = rng.randrange(len(TEXTS[name])), rng.randrange(120, 600)
        text = (TEXTS[name] * 8)[at : at + size]
        page = text if rng.random() < 0.5 else f"<html><body class='main'>\n<p>{text[: size // 2]}</p> <a href='index.html?id={at}'>Home</a> 2024-06-01 <p>{text[size // 2 :]}</p></body></html>"
        raw = page.encode(name)
        right += len(raw) <= 200 or E.decode_page(raw, None) == page
    assert right >= 0.99 * tried


def test_utf8_ascii_short_and_broken():
    assert C.detect(ZH.encode()) == "utf-8" and C.detect(b"plain") == "utf-8" and C.detect(b"") == "utf-8"
    assert C.detect("中文".encode("gbk")) is None and E.decode_page("中文".encode("gbk"), None) == "中文"
    broken = ZH.encode("gb18030")
    broken = broken[:40] + b"\xff" + broken[40:]
    assert C.detect(broken) == "gb18030" and E.decode_page(broken, None).startswith(ZH[:20]) and E.decode_page(broken, None).endswith(ZH[-20:])
    assert E.decode_page(None, None) is None and E.decode_page(b"", None) == ""
    assert E.decode_page(HANT.encode("big5"), "utf-8") == HANT  # a declared charset that does not fit


def test_declared_far_into_the_page():
    raw = (" " * 9000 + '<META http-equiv=x content="text/html; charset=Shift_JIS">' + JA[:6]).encode("shift_jis")
    assert E.decode_page(raw, None) == raw.decode("shift_jis")


def test_scores_are_sorted_and_models_cover_their_texts():
    for name, text in TEXTS.items():
        ranked = C.rank_code_pages(text.encode(name))
        assert [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True) and ranked[0][0] == name
        kinds = next(m for m in C.models() if m.page.name == name).kinds(text)
        assert C.KINDS.index("broken") not in kinds


def test_columns(spark):
    bodies = [(i, t.encode(n), None) for i, (n, t) in enumerate(TEXTS.items())] + [(90, ZH.encode(), "ISO-8859-1"), (91, None, None), (92, b"", "x-none"), (93, HANT.encode("big5"), "latin-1")]
    got = {r.id: r.html for r in E.decode_pages(spark.createDataFrame(bodies, "id int, body binary, charset string")).collect()}
    assert got == {i: t for i, t in enumerate(TEXTS.values())} | {90: ZH, 91: None, 92: "", 93: HANT}
