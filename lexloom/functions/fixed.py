"""Fixed values of the legal corpus: word lists and patterns that results depend on."""

from __future__ import annotations

# Colloquial terms and the formal ones that they stand for, in order.
ALIASES: list[tuple[str, list[str]]] = [
    ("醉驾", ["醉酒", "醉酒驾驶", "醉酒后驾驶"]),
    ("酒驾", ["饮酒", "饮酒后驾驶", "饮酒驾驶"]),
    ("醉驾入刑", ["醉酒驾驶机动车", "依法追究刑事责任"]),
    ("闯红灯", ["交通信号灯", "不按交通信号灯规定通行"]),
    ("违停", ["违法停车", "临时停车", "停车"]),
    ("超速", ["行驶速度", "超过规定时速", "限速"]),
    ("无证驾驶", ["未取得机动车驾驶证", "驾驶证", "驾驶资格"]),
    ("飙车", ["追逐竞驶", "竞速"]),
    ("疲劳驾驶", ["连续驾驶", "休息"]),
    ("套牌", ["伪造", "变造", "机动车号牌"]),
    ("遮挡号牌", ["机动车号牌", "妨碍交通监管"]),
    ("电动车", ["电动自行车", "非机动车"]),
    ("自动驾驶", ["智能网联汽车", "自动驾驶系统"]),
    ("无人驾驶", ["智能网联汽车", "自动驾驶"]),
    ("扣分", ["记分"]),
    ("车祸", ["交通事故"]),
    ("撞人", ["交通事故", "人身伤亡"]),
    ("记满12分", ["记分", "重新考试"]),
    ("玩手机", ["拨打接听手持电话", "手持电话", "移动电话", "电子设备", "妨碍安全驾驶"]),
    ("看手机", ["拨打接听手持电话", "手持电话", "移动电话", "妨碍安全驾驶"]),
    ("打电话", ["拨打接听手持电话", "手持电话"]),
    ("接电话", ["拨打接听手持电话", "手持电话"]),
    ("开车", ["驾驶机动车"]),
    ("超载", ["超过核定载质量", "超过核定人数"]),
    ("超员", ["超过核定人数"]),
    ("不系安全带", ["使用安全带"]),
    ("不戴头盔", ["安全头盔"]),
    ("礼让行人", ["人行横道", "遇行人正在通过"]),
    ("占用应急车道", ["应急车道"]),
    ("变道", ["变更车道"]),
    ("乱开远光灯", ["远光灯", "不按规定使用灯光"]),
]

# Parts of law names that hint at no law.
GENERIC: list[str] = [
    "中华人民共和国",
    "经济特区",
    "深圳经济特区",
    "实施条例",
    "条例",
    "规定",
    "办法",
    "处罚",
    "违法行为",
    "违法",
    "行为",
    "道路交通",
    "道路交通安全",
    "交通",
    "道路",
    "安全",
    "管理",
    "机动车",
    "驾驶",
    "车辆",
    "汽车",
    "法",
    "中华人民共和国道路",
    "交通事故",
    "交通事故责任",
    "机动车交通事故",
    "道路运输",
    "运输",
    "保险",
    "机动",
]

# Ids of known laws.
LAW_IDS: dict[str, str] = {
    "中华人民共和国道路交通安全法": "road_traffic_safety_law",
    "中华人民共和国道路交通安全法实施条例": "road_traffic_safety_regulation",
    "深圳经济特区智能网联汽车管理条例": "sz_icv_regulation",
    "深圳经济特区道路交通安全违法行为处罚条例": "sz_traffic_penalty_regulation",
    "中华人民共和国道路运输条例": "road_transport_regulation",
    "机动车交通事故责任强制保险条例": "traffic_insurance_regulation",
    "机动车驾驶证申领和使用规定": "driving_license_regulation",
    "道路交通安全违法行为记分管理办法": "demerit_points_measures",
}

# Chinese numerals.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = "[零一二三四五六七八九十百千]"

# Heading, list and noise patterns of the corpus format.
ARTICLE_REF = f"第{NUMERAL}+条"
LIST_MARKER = r"^\s*(?:[（(][一二三四五六七八九十百千\d]+[）)]|[①-⑳]|[一二三四五六七八九十]+[、.]|\d+[.．、])"
LINE_PUNCTUATION = r"[，。；、：！？（）《》〈〉“”‘’,.!?;:()\[\]{}<>]"
LINE_NOISE = r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}|中国政府网|gov\.cn|网站标识码|^\d{1,3}\s*/\s*\d{1,3}$|^\d+$|^/$|^_+$|^https?://"
BLOCK_HEAD = r"^第[一-鿿]+[章节](?=\s|$)|^第[一-鿿]+条(?=\s|$)|^附\s?则$"

# Lines that open chapters, sections and articles ({n}: numerals of a heading), and the table of contents.
CHAPTER_LINE = r"(?s)^第{n}章[\s　]*[^\n]*$"
SECTION_LINE = r"^第{n}节[\s　]*[^\n]*$"
ARTICLE_LINE = rf"(?s)^第{NUMERAL}+条(?:[\s　]*.*)?$"
CONTENTS_LINE = r"^目\s*录$"
HEAD_MARK = "^第.+?[章节]"

# Names of places in law names, and the country's.
LOCAL_MARKS = "省|市|自治区|经济特区"
NATION = "中华人民共和国"

# A file's date, titles in marks, article numbers in questions, labels in answers.
FILE_DATE = r"_(\d{4})(\d{2})(\d{2})$"
TITLE = "《([^》]{2,80})》"
ASKED_NUMERAL = rf"第\s*({NUMERAL}+)\s*条"
ASKED_NUMBER = r"第\s*(\d{1,4})\s*条"
CITED_LABEL = r"[\[【]依据\s*(\d+)[\]】]"
ANSWER_MARK = r"\[(?:依据|时效|材料)\s*\d+\]|【(?:依据|时效|材料)\s*\d+】"

# Clauses that make a chapter's first article no evidence, and notes that a prompt leaves out.
PREAMBLE = "制定(?:本|该)(?:条例|法|规定|办法)"
SCOPE = "(适用|遵守)(本条例|本法)"
SILENT_NOTES = ["法名线索：", "未重排：", "重排失败"]

# The lines of a receipt, and of a search that fails.
RECEIPT_HEAD = "检索#%s「%s」｜命中 %s 条（新增 %s / 已知 %s）"
RECEIPT_EMPTY = "没有命中的法条。请换一组更接近法条原文的关键词，或补上具体违法情形与地点后重试。"
RECEIPT_NOTHING_NEW = "注意：本轮没有新增法条，与之前的检索重复。换个完全不同的角度，或直接结束检索。"
RECEIPT_KNOWN = "（上一轮已给过原文）"
RECEIPT_REFS = "    相关条："
RECEIPT_NOTE = "提示："
SEARCH_TIMEOUT = "检索超时（超过 %s 秒仍未返回），本次没取到结果。可以换一组关键词再试，或用更通用的说法。"
SEARCH_FAILURE = "检索失败：%s。可以换一组关键词再试，或用更通用的说法。"
TIMEOUT, FAILURE = "检索超时", "检索失败"
