"""Certificates, ranks and years of work that a notice demands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.dedupe import undominated
from .text import any_of, bind, text, trim, wide

# Names and patterns that decide, in their own order.
CATALOG = ("法律职业资格证书", "国家统一法律职业资格证书", "医师资格证", "医师执业证", "护士执业证", "教师资格证", "会计专业技术资格证", "会计从业资格证", "注册会计师", "注册建造师", "一级建造师", "二级建造师", "监理工程师", "造价工程师", "注册消防工程师", "电工证", "焊工证", "特种设备作业证", "驾驶证", "C1驾驶证", "计算机等级证书", "全国计算机等级考试", "出版专业技术人员职业资格", "新闻记者职业资格", "翻译专业资格", "社会工作者职业水平证书")
PATTERNS = wide((
    "(?:正|副)?(?:高|中|初)级(?:及以上|以上)(?:专业)?(?:技术)?职称",
    "(?:正高|副高|助理)级(?:及以上|以上)?(?:专业)?(?:技术)?职称",
    "(?:会计|审计|经济|统计|工程|教师|医师|护师|药师)系列(?:中|高|初)级(?:及以上|以上)职称",
    "(?:住院|主治|副主任|主任)医师(?:职称|资格)",
    "(?:高校|高等学校)?(?:讲师|副教授|教授)(?:职称|职务)?",
    "(?:讲师|副教授|教授|研究员|副研究员|助理研究员)(?:及以上|以上)(?:职称)?",
    r"[一-龥]{2,14}(?:执业)?(?:资格)?证书(?:\([^)]{1,10}\))?",
    "(?:国家统一)?法律职业资格(?:证书)?",
    "(?:大学英语|英语)(?:四|五|六|八)级(?:及以上|以上)?",
    r"(?:CET|cet)[-\s]?[468](?:级)?(?:及以上|以上)?",
    "普通话(?:水平)?(?:测试)?(?:等级)?(?:证书)?二级[一-龥]*等(?:及以上|以上)?",
    "普通话(?:水平)?(?:测试)?(?:等级)?(?:证书)?三级[一-龥]*等(?:及以上|以上)?",
    r"[0-9]+\s*年(?:以上)?(?:相关)?(?:工作|从教|从业|基层)?经验",
))
SCOPE = ("学校编制内(?:在)?(?:岗)?(?:职工|教职工)", "面向(?:全校|校内)(?:教职工|职工)", "须符合学校跨部门流动条件", "本校(?:编制内|在编)(?:人员|职工|教职工)?")
LEAD = "^(?:须|应|需|必须|应当|须具备|需具备|应具有|具有|持有|取得|持|具备)"
FRAGMENT = "^(?:及|或|等|的|和|与|须|应|需|具有|具备|以上|以下|及以上|及以下|中级|高级|初级|职称|专业|技术|系列|资格|学历|学位)$"
RANKS = "初级|中级|高级|正高|副高|助理|员级|住院|主治|副主任|主任|讲师|副教授|教授|研究员|副研究员|会计师|工程师|经济师|系列|正高级|副高级"
BLOCKED = "毕业|学位|学历|身份|居住|保证|承诺|授权|协议|诚信|体检|考察|公示|品行|政治|拥护|热爱|遵纪|守法|健康|无犯罪|征信|档案|户籍|生源|面试|笔试|复审|调剂|递补|附件|表格|一览|招聘|岗位|计划|序号|单位名称|咨询电话|报名|缴费"
BLOCKED_ENDS = "(?:保证书|承诺书|授权书|协议书|介绍信|证明信|推荐表|证明材料|证明)$"
NO_CERTIFICATE = "(?:经历|荣誉|工作|身份|学历|学位|在职|组织|户口|婚姻|无犯罪|廉洁|健康|业绩|成果|关系|党员|政治|材料|情况|业绩|获奖|任职)证$"


def fragment(c: Column) -> Column:
    """Without up to four leading verbs, and without what follows a comma or full stop."""
    out = trim(c)
    for _ in range(4):
        out = trim(F.regexp_replace(out, LEAD, ""))
    return trim(F.regexp_replace(out, "[，,；;。].*$", ""))


def catalog_name(v: Column, catalog=CATALOG) -> Column:
    """The longest name of the catalog in a fragment, the first of equals, else the fragment."""
    ordered = sorted(catalog, key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(v, F.lit(name)), name) for name in ordered], v)


def is_item(c: Column, catalog=CATALOG) -> Column:
    """Whether a phrase names a whole certificate, rank, level or years of work."""

    def item(v: Column) -> Column:
        ranked = F.contains(v, F.lit("职称")) & v.rlike(RANKS)
        whole = F.length(v).between(3, 32) & ~v.rlike(FRAGMENT) & ~v.rlike("^(?:及|或)?以上(?:职称|学历|学位)?$|^及以上(?:职称)?$") & (~F.contains(v, F.lit("职称")) | ranked)
        known = any_of(v, catalog)
        barred = v.rlike(BLOCKED) | v.rlike(BLOCKED_ENDS) | v.rlike(NO_CERTIFICATE) | v.startswith("证") | (v.rlike("证$") & ~v.rlike("(?:资格证|执业证)$") & ~known)
        part = F.exists(F.array(*map(F.lit, catalog)), lambda name: F.contains(name, v))
        shaped = v.rlike("普通话") & v.rlike("级") | v.rlike("(?i)大学英语|英语|CET") & v.rlike("[四五六八]") | v.rlike(r"[0-9]+\s*年(?:以上)?(?:相关)?(?:工作|从教|从业|基层)?经验") | ranked | v.rlike("[一-龥]{2,12}(?:执业)?(?:资格)?证书$|[一-龥]{2,8}(?:资格|执业)证$")
        return whole & ~barred & (known | part | shaped)

    return bind(fragment(c), item)


def items(*sources: Column, most: int = 8) -> Column:
    """array<string>: what the sources demand, each once, without parts of another, in the order of the rules."""
    whole = F.concat_ws("\n", *[bind(text(s), lambda v: F.when(v != "", v)) for s in sources])

    def found(blob: Column) -> Column:
        clauses = F.filter(F.transform(F.split(blob, "[；;\n\r|｜/、,，]+"), trim), lambda v: F.length(v) >= 2)

        def matched(part: Column) -> Column:
            raw = F.flatten(F.array(*[F.regexp_extract_all(part, F.lit(f"((?i){p})" if p.startswith("(?:CET") else f"({p})"), 1) for p in PATTERNS]))
            named = F.filter(F.transform(raw, lambda m: bind(fragment(m), lambda v: catalog_name(v))), lambda v: is_item(v))
            return F.transform(named, lambda v: F.when(v.rlike("(?i)普通话|英语|CET"), F.regexp_replace(v, "(?:及)?以上$", "")).otherwise(v))

        def listed(part: Column) -> Column:
            return F.filter(F.array(*map(F.lit, CATALOG)), lambda name: F.contains(part, name))

        scope = F.filter(F.flatten(F.array(*[F.regexp_extract_all(blob, F.lit(f"({p})"), 1) for p in SCOPE])), lambda v: F.length(v).between(4, 32))
        each = F.flatten(F.transform(clauses, lambda part: F.concat(listed(part), matched(part))))
        return F.concat(listed(blob), matched(blob), scope, each)

    return bind(bind(whole, found), lambda all_items: undominated(all_items, most))
