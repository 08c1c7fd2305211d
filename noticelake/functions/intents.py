"""What a typed request for notices asks for, as column expressions: topic words, place, span of time, schedule, kind of notice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words of requests, in the order in which they are tried
STOP_WORDS = (
    "北京", "上海", "广东", "深圳", "浙江", "江苏", "四川", "湖北", "山东",
    "河南", "福建", "安徽", "天津", "重庆", "湖南", "河北", "江西", "广西",
    "云南", "贵州", "陕西", "甘肃", "青海", "宁夏", "新疆", "西藏", "海南",
    "内蒙古", "黑龙江", "吉林", "辽宁", "山西",
    "最近", "的", "公告", "系统", "信息", "政府", "人民政府",
    "30天", "7天", "15天", "5天", "1天", "3天", "三个月", "一个月",
    "30d", "7d", "15d", "5d", "1d", "3d", "90d", "最近30天", "最近7天", "最近15天", "最近5天", "最近3天", "最近1天", "最近三个月", "最近一个月",
    "天", "月", "年", "本期",
    "所有", "的标", "所有的", "所有的标", "全部", "全部的", "全部的标", "所有项目", "全部项目", "所有公告", "全部公告",
    "所有中标", "全部中标", "所有招标", "全部招标",
)
DOMAIN_WORDS = (
    "医疗", "教育", "格力", "空调", "电脑", "软件", "云服务", "安保", "保安", "保洁", "物业", "装修", "工程", "建筑", "绿化",
    "家具", "印刷", "车辆", "电梯", "消防", "网络", "服务器",
)
REGION_PREFIXES = (
    "北京", "上海", "广东", "深圳", "浙江", "江苏", "四川", "湖北", "山东", "河南", "天津", "重庆", "福建", "安徽", "湖南", "江西",
    "辽宁", "吉林", "黑龙江", "山西", "陕西", "甘肃", "青海", "云南", "贵州", "海南", "河北", "内蒙古", "新疆", "西藏", "宁夏", "广西",
    "台州", "杭州", "宁波", "温州", "嘉兴", "湖州", "绍兴", "金华", "衢州", "舟山", "丽水",
)
CITY_PREFIXES = ("深圳", "台州", "杭州", "宁波", "温州", "嘉兴", "湖州", "绍兴", "金华", "衢州", "舟山", "丽水")
SUFFIXES = ("政府采购", "政府", "系统", "公告", "招标", "采购", "项目", "信息", "中标", "成交", "公司", "集团", "管理局", "委员会", "中心", "办公室")
ORG_SUFFIXES = ("医院", "大学", "学院", "公司", "集团", "局", "委员会", "厅", "院", "中心", "研究所", "研究院")
CITIES = ("台州", "杭州", "宁波", "温州", "嘉兴", "湖州", "绍兴", "金华", "衢州", "舟山", "丽水", "深圳", "青岛", "大连", "厦门", "苏州", "无锡", "南京")
PROVINCES = (
    "北京", "上海", "广东", "浙江", "江苏", "四川", "湖北", "山东", "河南", "福建", "安徽", "湖南", "江西",
    "辽宁", "吉林", "河北", "山西", "陕西", "甘肃", "云南", "贵州", "海南", "青海", "天津", "重庆",
)
TOPICS = {
    "服务器": ("服务器", "机架", "刀片"),
    "充电桩": ("充电桩", "充电站", "充电设备"),
    "IT设备": ("IT", "信息化", "计算机", "网络设备"),
    "医疗器械": ("医疗", "器械"),
    "建筑工程": ("建筑", "工程", "施工"),
    "政府采购": ("政府采购", "采购"),
    "教育": ("教育", "学校", "教学", "图书", "培训"),
    "环保": ("环保", "环境", "生态", "污水处理"),
    "安防": ("安防", "监控", "消防", "安保"),
    "保洁": ("保洁", "物业", "绿化", "环卫"),
}
# ---- end of fixed values


def _has(text: Column, *words: str) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _first(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the listed words that a text holds, in the list's order."""
    return F.coalesce(*(F.when(_has(text, w), F.lit(w)) for w in words))


def _held(text: Column, words: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(_has(text, w), F.lit(w)) for w in words)))


def split_topic(text: Column) -> Column:
    """Distinct search words of a sentence, in order: cities taken off the front, domain words, or what is left of 2 to 6 characters.

    Regions come off the front and general words off the end as long as two characters stay. Null or empty: none.
    """
    head = "^(?:(?:" + "|".join((*REGION_PREFIXES, "省", "市")) + ")(?=(?s:..)))+"
    tail = "^((?s:.{2,}?))(?:" + "|".join(SUFFIXES) + ")+$"
    none = F.array().cast("array<string>")

    def words(part: Column) -> Column:
        front = F.regexp_extract(part, head, 0)
        rest = F.substring(part, F.length(front) + 1, F.length(part))
        cleaned = F.trim(F.regexp_replace(rest, tail, "$1"))
        domain = _held(cleaned, DOMAIN_WORDS)
        short = lambda c, n: (F.length(c) >= 2) & (F.length(c) <= n)
        own = F.when(F.size(domain) > 0, domain).when(short(cleaned, 6), F.array(cleaned)).when(short(part, 3), F.array(part)).otherwise(none)
        cities = F.regexp_extract_all(front, F.lit("(" + "|".join(CITY_PREFIXES) + ")"), F.lit(1))
        return F.concat(cities, F.when((cleaned == "") | cleaned.isin(*STOP_WORDS), none).otherwise(own))

    parts = F.split(F.coalesce(text, F.lit("")), "[\\s,，。；;、（）()【】\\[\\]]+")
    wanted = F.filter(parts, lambda p: (p != "") & ~p.isin(*STOP_WORDS))
    return F.array_distinct(F.flatten(F.transform(wanted, words)))


def fix_topic(topic: Column) -> Column:
    """A topic that is a whole sentence gives its first search word; a short one, or one without such a word, stays."""
    long = (F.length(topic) > 6) | _has(topic, " ", "最近", "天", "公告", "招标")
    return F.when(long, F.coalesce(F.try_element_at(split_topic(topic), F.lit(1)), topic)).otherwise(topic)


def parse(text: Column) -> Column:
    """struct(topic, region, time_range, frequency, trigger_type, keywords, notice_type) of a request; what it does not name is null.

    An organisation (up to six characters before its kind) is the topic and leaves no region. A city goes before a
    province; with both the city is a keyword too. Without a span of time 30 days are meant. Null text: as empty.
    """
    q = F.coalesce(text, F.lit(""))
    suffix = _first(q, ORG_SUFFIXES)
    at = F.instr(q, suffix)
    start = F.greatest(at - 6, F.lit(1))
    org = F.substring(q, start, at - start + F.length(suffix))
    none = F.array().cast("array<string>")
    city, province = (F.when(org.isNull(), _first(q, w)) for w in (CITIES, PROVINCES))
    topic = F.coalesce(org, *(F.when(_has(q, *w), F.lit(t)) for t, w in TOPICS.items()))
    held = F.coalesce(*(F.when(_has(q, *w), _held(q, w)) for w in TOPICS.values()), none)
    keywords = F.when(org.isNotNull(), F.array(org)).otherwise(F.concat(F.when(city.isNotNull() & province.isNotNull(), F.array(city)).otherwise(none), held))
    span = (
        F.when((_has(q, "最近") & _has(q, "3月")) | _has(q, "3个月"), "3m")
        .when((_has(q, "最近") & _has(q, "一月")) | _has(q, "1个月", "30天"), "30d")
        .when(_has(q, "15天"), "15d")
        .when(_has(q, "5天"), "5d")
        .when(_has(q, "本周", "7天"), "7d")
        .when(_has(q, "今天", "1天"), "1d")
        .otherwise("30d")
    )
    often = F.when(_has(q, "每天"), "0 9 * * *").when(_has(q, "今天") & _has(q, "9:00"), "once:09:00").when(_has(q, "每周一"), "0 9 * * 1")
    kind = F.when(_has(q, "中标", "成交"), "award").when(_has(q, "更正", "变更"), "correction").when(_has(q, "招标", "采购"), "tender")
    return F.struct(
        topic.alias("topic"), F.coalesce(city, province).alias("region"), span.alias("time_range"), often.alias("frequency"),
        F.when(often.isNotNull(), "scheduled").otherwise("immediate").alias("trigger_type"), keywords.alias("keywords"), kind.alias("notice_type"),
    )
