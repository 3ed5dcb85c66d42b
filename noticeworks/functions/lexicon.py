"""Word lists and patterns of the notice rules, as data; every rule takes them as parameters."""

from .text import wide

# Words and patterns that decide results, in their own order.
NAV_WORDS = ("首页", "机构设置", "职能简介", "领导分工", "部门职责", "联系方式", "政策制度", "人才计划", "办事指南", "站内搜索", "版权所有", "师资队伍", "师资培养", "薪酬与福利", "编制与调配", "社会保险", "档案管理", "职称岗位", "新进教师", "常用下载", "网站地图", "English", "旧版回顾", "政策规章")
CORE_WORDS = ("招聘", "公开招聘", "岗位", "计划招录", "名额", "招聘计划", "专任教师", "辅导员", "专技岗位", "选聘", "遴选", "招贤")
OTHER_NOTICES = (
    "拟聘用|拟录用",
    "拟录(?:用|取)?人选",
    "(?:入围|终选|初选|通过|合格).*名单",
    "(?:公布|发布).*人员名单",
    "人员名单(?:的)?通知",
    "考场安排",
    "(?:笔试|面试|试讲|体[检验]).*(?:安排|通知|公告|事项)",
    "(?:资格|现场).*确认",
    "资格初审(?:结果)?",
    "初选结果",
    "(?:体检|政审|考察)(?:和|及|、)?(?:政审|考察)?(?:安排|通知|公告)?",
    "体检和?(?:政审|政)",
    "(?:聘用|录用).*?(?:拟)?(?:聘用|录用)",
    "考核结果(?:公示|公布)?",
    "(?:培养计划|中期考核).*?(?:通知|公示)",
    "教师队伍建设",
    "学习贯彻",
    "结果公示",
    "(?:招聘)?(?:拟)?(?:聘用|录用).*公示",
    "拟聘.*?(?:公示|通知)",
    "(?:入围|通过).*?(?:公示|通知)",
    "递补(?:公告|通知|人员)?",
    "(?:放弃|改报|取消)(?:资格|岗位)?(?:的)?(?:公告|通知)?",
    "(?:公布|发布|公示).*?成绩",
    "(?:公布|发布|公示).*?(?:笔|面|试|讲)试?(?:成绩|分数)",
    "(?:笔|面|试|讲)试?(?:成绩|分数).*(?:公布|公示|通知|排名)",
    "成绩(?:的)?(?:通知|公布|公示|排名)",
    "(?:合成|总)成绩",
    "(?:初审|资格审查|资格复核)(?:通过|合格).*?(?:人员|名单)",
    "(?:初审|资格审查)(?:通过|合格)",
    "(?:通过|合格)人员(?:名单)?(?:的)?通知",
    "(?:公布|发布|公示).*?(?:资格)?(?:审查|复核)(?:结果|情况)",
    "(?:资格)?(?:审查|复核)结果(?:的)?(?:通知|公布|公示)?",
    "现场资格复核",
    "资格审查(?:结果|情况)",
    "资格复核(?:结果|情况)",
    "考试工作安排",
    "(?:笔|面|试|讲)试?(?:的)?(?:通知|公告|安排|事项)",
    "公开招聘.*?笔(?:试)?(?:的)?(?:通知|公告)",
    "关于做好.*?(?:体检|考察|心理测试)",
    "(?:体检|心理测试|考察)(?:工作)?(?:的)?通知",
    "及(?:体检|心理测试)",
)
SPAM_WORDS = ("站内搜索", "版权所有", "办事指南", "机构设置", "政策规章", "师资队伍", "常用下载", "联系我们")
CONTENT_WORDS = ("招聘", "公告", "岗位", "计划", "人员", "选聘", "编制")
RESULT_WORDS = ("拟聘用", "拟录用", "录用名单", "聘用人员公示", "入围名单", "结果公示")
RESULT_MARKERS = ("拟聘用", "公示期", "名单如下")
TRACK_WORDS = ("编制", "事业编", "高校", "大学", "学院", "研究所", "博士", "申博", "博士后", "人才引进", "辅导员", "科研助理")
TRACKS = (("博士/申博/博后", "博士|申博|博后|招生简章|考核制|博士后"), ("地方编制求职", "事业编|事业单位|人才引进|编制|选调"), ("高校院所招聘", "高校|大学|学院|辅导员|科研助理|研究所|院所"))
NO_DEADLINE = "未明确|另行通知|长期|常年|面议|不限|待定|招满即止|详见|以公告为准"
NO_EDUCATION = "^(?:暂未公布|暂未确定|待定|另行通知|详见(?:公告)?|以公告为准|—|-+|无|暂无|/|NULL|N/A)$"
ANY_EDUCATION = "无要求|不限学历|学历不限|不作学历要求|无学历要求|学历不作要求|不限"
EDUCATION = (("博士研究生及以上", "博士"), ("硕士研究生及以上", "硕士|研究生"), ("本科及以上", "本科|学士"), ("大专及以上", "大专|专科|高职"))
EDUCATION_PHRASE = "(?:全日制)?(?:博士研究生|硕士研究生|大学(?:本科|专科)|研究生|博士|硕士|本科学[历位]|本科|大专|专科|高中|中专|技校|高职)(?:及以上|以上|及以下|以下|学位|学历)?"
EDUCATION_LABELS = wide((r"学历(?:学位)?(?:要求)?[:：]\s*([^\n\r，,；;]{2,48})", r"学位(?:类别|要求)?[:：]\s*([^\n\r，,；;]{2,48})"))
NO_EDUCATION_CELL = "招聘|岗位|计划|一览表|附件|序号|单位名称|用人单位|咨询电话|报名|中学|小学|学院|大学校|专业要求|年龄要求|政治面貌|资格条件|代码|人数"
SCHOOL_PROSE = "坐落于|占地面积|年历史|追溯到|设有.*(?:学院|专业)|本科专业|湖岸线|美誉|人事管|学位证书原件|学信网|毕业生就业推荐"
SCRAPE_JUNK = wide((r"^首页\s", r"(?i)\.[a-zA-Z][\w-]*\s*\{|dropselect|SimpleSelect|li\.hover", r"\{\s*[^}]{0,120}\}", r"[|｜]\s*中国(?:政府网|(?:人民共和国)?[一-龥]{2,24}部)", r"(?:^|[·•.])\s*\.[a-zA-Z_-]"))
SCRAPE_CUT = wide(r"[·•.]\s*\.[a-zA-Z_-]|\.[a-zA-Z_-][\w-]*\s*\{|\s*\{[^}]*\}|\s*中国政府网\s*[|｜]")
FOOTER_CUT = wide(r"\s*[|｜]\s*中国(?:政府网|(?:人民共和国)?[一-龥]{2,24}部).*$")
GARBLED = wide((r"(?i)工作表:\s*sheet", r"^---+\s*$", "[ÃÂÐÞæœ]|ï¿½|â€", "(?i)nèh\\s*kâ|nánh|tuổi"))
#: Why a text is no card title: ordered, after the empty, garbled, menu and other-notice ones.
FORM_TITLE = wide(r"(?i)报名表|申请表|(?:^|[\s，,])岗位表(?:$|[\s，,])|附件\s*[0-9]|\.xlsx|\.pdf|\.docx|\.doc$")
BAD_TITLES = wide((("sheet", r"(?i)^工作表:|^Sheet[0-9]+|^---+\s*工作表"), ("header", None), ("page_mark", r"(?i)^--\s*[0-9]+\s+of\s+[0-9]+"), ("fragment", r"^及名额\s"), ("opening", "^(?:因工作需要|根据《|经研究|各校属|各学院|现将|现予?以公示|为做好)"), ("campus", "是经教育部批准|办学层次|博士学位授予|校园环境优美")))
HEADER_WORDS = "(?:主管部门|招聘单位|岗位名称|岗位代码|计划数|部门)"
LIST_TITLE = "一览表|计划数及要求"
LIST_TAIL = "(?:岗位、计划数及要求|岗位计划及要求|岗位、计划数|计划数及要求)?一览表.*$"
LIST_FILE = wide(r"(?i)表\s*[0-9]*\.(?:xlsx|xls|pdf|docx)?$")
POST_NAMES = wide((
    r"(?:一、)?(?:招聘岗位及人数|招聘岗位及岗位职责|招聘岗位)[：:\s]*([^\n。；]{2,40}?)(?:[0-9]+\s*名|[。\n])",
    r"岗位职责\s+([一-龥]{2,24}(?:员|师|专员|科员|秘书|人员|工程师|助理|管理))\s*[0-9]+\s*名",
    "[一-龥]{2,24}(?:学院|中心|书院|馆|处|部)(?:决定)?面向(?:全校|校内).*?公开招聘([一-龥]{2,20}(?:人员|教师|专员|秘书|科员|工程师|管理))",
))
NO_POST_NAME = "岗位名称|职数|岗位职责|任职基本"
TITLE_LINE = "招聘|岗位|引进|招贤|公开招聘"
GENERIC_TITLE = "管理辅助岗位|校内(?:招聘|选聘)|公开招聘(?:管理|专技)?(?:人员|公告)"
OUTSIDE_STAFF = "非事业编(?:制)?"
ANY_MAJOR = wide("不限专业|专业不限|无专业要求|不作专业要求|专业不作要求|各类专业|所有专业|不限报考专业|不限制专业|专业不限制|无专业限制|^专业\\s*[:：]?\\s*(?:不限|无)|^(?:不限|无)$")
PARTY_WORDS = ("中共党员", "中共预备党员", "预备党员", "限党员", "面向党员", "须为中共党员", "须中共党员", "限中共党员")
ANY_MAJOR_WORDS = ("专业不限", "不限专业", "专业要求不限", "不作限制")
REGION_ENDINGS = "特别行政区|壮族自治区|回族自治区|维吾尔自治区|自治区|自治州|地区|盟|省|市|区|县"
#: Ordered: the first whose number is in range decides.
AGE_LIMITS = wide((r"(\d{1,3})\s*周岁\s*及?\s*以[下内]", r"(\d{1,3})\s*周岁以下", r"不超过\s*(\d{1,3})\s*周岁", r"(\d{1,3})\s*岁\s*及?\s*以下", r"年龄\s*(?:在\s*)?(\d{1,3})\s*周岁"))
#: The matcher of bare texts has its own order and words.
TEXT_AGE_LIMITS = wide((r"(\d{1,3})\s*周岁以下", r"不超过\s*(\d{1,3})\s*周岁", r"(\d{1,3})\s*周岁\s*及\s*以下", r"(\d{1,3})\s*岁\s*及\s*以下", r"年龄\s*(?:在\s*)?(\d{1,3})\s*周岁"))
TEXT_PARTY_WORDS = ("中共党员", "限党员", "面向党员", "须为中共党员", "须中共党员", "限中共党员")
