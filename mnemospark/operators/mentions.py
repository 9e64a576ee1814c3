"""Rule-based mentions in texts: contacts, dates, names, places, brands and events.

Rules are patterns with a label and a confidence. Matches of a text are found by one
Arrow pass over whole texts; overlaps and repeats are settled by array expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, patterns and confidences of the rules.
SURNAMES = (
    "王李张刘陈杨黄赵周吴徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任"
    "沈姚卢姜崔钟谭陆汪范金石廖贾夏韦傅方白邹孟熊秦邱江尹薛闫段雷侯龙史黎贺顾毛郝龚邵万钱"
)
NAME_SUFFIXES = ("先生", "女士", "小姐", "老师", "医生", "经理", "总", "董")
TITLES = {
    "老婆": 0.95, "老公": 0.95, "妻子": 0.95, "丈夫": 0.95,
    "爸爸": 0.95, "妈妈": 0.95, "父亲": 0.95, "母亲": 0.95,
    "爸妈": 0.90, "父母": 0.90,
    "哥哥": 0.95, "姐姐": 0.95, "弟弟": 0.95, "妹妹": 0.95,
    "儿子": 0.95, "女儿": 0.95, "孩子": 0.85,
    "爷爷": 0.95, "奶奶": 0.95, "外公": 0.95, "外婆": 0.95,
    "岳父": 0.95, "岳母": 0.95, "公公": 0.95, "婆婆": 0.95,
    "男朋友": 0.95, "女朋友": 0.95, "男友": 0.95, "女友": 0.95,
    "同事": 0.85, "朋友": 0.80, "同学": 0.80,
}
TIME_CHARACTERS = "天晚早午晨夜点分秒周月日年"
STOP_CHARACTERS = "的在是和与跟到去就来有要约"
COMMON_WORDS = (
    "我们 你们 他们 她们 它们 人们 这里 那里 哪里 非常 很多 不少 一些 一起 一定 一样 一般 一直 可以 可能 可是 可惜 可怕 "
    "就是 都有 还有 没有 如果 因为 所以 虽然 但是 自己 别人 大家 各位 什么 怎么 多少 几 谁 哪"
).split()
ENGLISH_STOP = "The This That There Today Tomorrow Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
PLACE_SUFFIXES = (
    "店", "餐厅", "咖啡馆", "咖啡厅", "酒店", "机场", "车站", "医院", "学校",
    "公园", "广场", "大厦", "中心", "大楼", "小区", "公寓", "别墅", "馆",
    "厅", "室", "园", "场", "院", "所", "部", "处", "局", "公司", "银行",
)
RULES: tuple[tuple[str, float, str], ...] = (
    ("DATE", 0.95, r"\d{4}年\d{1,2}月\d{1,2}[日号]?"),
    ("DATE", 0.95, r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
    ("DATE", 0.90, r"\d{1,2}月\d{1,2}[日号]"),
    ("DATE", 0.95, "今天|昨天|明天|后天|大后天|前天"),
    ("DATE", 0.92, "星期[一二三四五六日天]|周[一二三四五六日]"),
    ("DATE", 0.90, "(?:上周|这周|本周|下周)[一二三四五六日]?"),
    ("TIME", 0.88, "早(?:晨|上)|上午|中午|下午|晚上|凌晨|傍晚|夜间"),
    ("TIME", 0.95, r"\d{1,2}[:：]\d{2}"),
    ("TIME", 0.90, r"[上下]午\s*\d{1,2}\s*[点：](?:\d{1,2}[分]?)?"),
    ("TIME", 0.88, r"\d{1,2}\s*点\s*(?:半|\d{1,2}\s*分)?"),
    ("EMAIL", 0.98, r"[\w.-]+@[\w.-]+\.\w+"),
    ("PHONE", 0.98, r"1[3-9]\d{9}"),
    ("PHONE", 0.95, r"0\d{2,3}[-]?\d{7,8}"),
    ("URL", 0.97, r"https?://[^\s。，]+"),
    ("IP", 0.95, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("PERSON", 0.90, "[一-龥]{1,2}(?:先生|女士|小姐|老师|医生|教授)(?![一-龥])"),
    ("PLACE", 0.82, f"[一-龥]{{2,8}}(?:{'|'.join(PLACE_SUFFIXES)})"),
    ("PLACE", 0.90, "家|家里|家中"),
    ("PLACE", 0.90, "公司|单位|办公室"),
    ("PLACE", 0.88, "学校|大学|学院|中学|小学"),
    ("GPE", 0.95, "北京|上海|广州|深圳|杭州|南京|成都|武汉|西安|重庆|天津|苏州"),
    ("GPE", 0.95, "中国|美国|日本|韩国|英国|法国|德国|意大利|西班牙|加拿大|澳大利亚"),
    ("ORG", 0.85, "[一-龥]{2,10}(?:科技|技术|网络|软件|信息|咨询|文化|传媒|教育|医疗|金融|投资|集团|股份|有限)公司?"),
    ("ORG", 0.88, "[一-龥]{2,10}(?:集团|银行|证券|保险|基金|信托)"),
    ("PRODUCT", 0.95, "微信|微博|抖音|小红书|淘宝|天猫|京东|拼多多|美团|滴滴|支付宝|网易云音乐|QQ|B站|知乎"),
    ("BRAND", 0.90, "苹果|华为|小米|三星|索尼|耐克|阿迪达斯|星巴克|麦当劳|肯德基"),
    ("EVENT", 0.88, "会议|例会|周会|月会|年会|晨会|夕会|讨论会|评审会|发布会"),
    ("EVENT", 0.85, "聚会|聚餐|约会|派对|晚宴|午餐|晚餐|早餐|下午茶"),
    ("EVENT", 0.87, "面试|考试|测试|考核|评估|答辩"),
    ("EVENT", 0.82, "旅行|旅游|出差|度假|郊游|露营|登山|跑步|健身|游泳"),
    ("EVENT", 0.85, "电影|演唱会|展览|演出|比赛|球赛|音乐会"),
    ("EVENT", 0.88, "生日|纪念日|节日|假期|周末|周年庆"),
)
_COMPILED = tuple((label, conf, re.compile(p)) for label, conf, p in RULES)
# longer titles first, so that none is found inside another
_TITLE = re.compile("|".join(sorted(TITLES, key=lambda t: (-len(t), t))))
_NAME = re.compile(f"(?=([{SURNAMES}])([一-龥]{{1,2}}))")
_ENGLISH = re.compile(r"\b[A-Z][a-z]{1,10}\b")
_BODY = re.compile(f"[{TIME_CHARACTERS}]")
SPAN = "array<struct<start:int,neg:double,end:int,text:string,label:string>>"


def names(text: str) -> Iterator[tuple[str, float, int, int]]:
    """(label, confidence, start, end) of personal names: a surname with one or two characters, a capitalised word."""
    free: dict[str, int] = {}
    for m in _NAME.finditer(text):
        # the same surname is looked for again after its last candidate
        if m.start() < free.get(m[1], 0):
            continue
        free[m[1]] = m.end(2)
        if m[1] + m[2] in COMMON_WORDS or _BODY.search(m[2]):
            continue
        name = (m[1] + m[2]).rstrip(STOP_CHARACTERS)
        end = m.start() + len(name)
        if len(name) > 1:
            yield "PERSON", 0.85 if any(s in text[end : end + 4] for s in NAME_SUFFIXES) else 0.70, m.start(), end
    for m in _ENGLISH.finditer(text):
        if m[0] not in ENGLISH_STOP:
            yield "PERSON", 0.65, m.start(), m.end()


def find(text: str | None) -> list[tuple[int, float, int, str, str]]:
    """(start, -confidence, end, text, label) of all matches, repeats of a span only with the best confidence."""
    text = text or ""
    found = [("PERSON", TITLES[m[0]], m.start(), m.end()) for m in _TITLE.finditer(text)]
    found += [(label, conf, m.start(), m.end()) for label, conf, p in _COMPILED for m in p.finditer(text)]
    best: dict[tuple[int, int], tuple[int, float, int, str, str]] = {}
    for label, conf, start, end in [*found, *names(text)]:
        if (start, end) not in best or -conf < best[start, end][1]:
            best[start, end] = (start, -conf, end, text[start:end], label)
    return sorted(best.values())


def resolved(spans: Column) -> Column:
    """Spans sorted by start and falling confidence, less each that overlaps one kept before it."""
    empty = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(spans, empty, lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text, label, confidence): one row per mention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("neg", pa.float64()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string())]))
        names = ("start", "neg", "end", "text", "label")
        for b in batches:
            rows = [[dict(zip(names, r, strict=True)) for r in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [key, "spans"])

    found = docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPAN}")
    one = found.select(key, F.explode(resolved(F.col("spans"))).alias("m"))
    return one.select(key, "m.start", "m.end", "m.text", "m.label", (-F.col("m.neg")).alias("confidence"))


def relations(found: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, subject, predicate, object, confidence) of ordered mention pairs of a text with a known word between or before them."""
    patterns = {"和": "WITH", "跟": "WITH", "与": "WITH", "去": "GOES_TO", "在": "AT"}
    a = found.select(key, F.col("text").alias("subject"), F.col("end").alias("a_end"), F.col("label").alias("a_label"))
    b = found.select(key, F.col("text").alias("object"), F.col("start").alias("b_start"))
    pairs = a.join(b, key).where("b_start >= a_end and b_start - a_end <= 6 and a_label = 'PERSON'").join(docs.select(key, text), key)
    between = F.expr(f"substring(`{text}`, a_end + 1, b_start - a_end)")
    pick = F.when(F.lit(False), "")
    for word, name in patterns.items():
        pick = pick.when(between.contains(word), name)
    return pairs.withColumn("predicate", pick).where("predicate is not null").select(key, "subject", "predicate", "object", F.lit(0.6).alias("confidence")).distinct()
