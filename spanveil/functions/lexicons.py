"""Small word lists for names, organizations and addresses. A list is data: pass others to the detector to replace them."""

from __future__ import annotations

# Words and phrases of the library's own choice, by kind.
LABELS = {
    "name": ("name", "full name", "姓名", "住客姓名", "联系人", "收件人"),
    "organization": ("company", "organization", "employer", "公司", "单位", "机构"),
    "address": ("address", "home address", "country/region", "地址", "住址", "收货地址", "住址道路"),
    "phone": ("phone", "mobile", "mobile number", "tel", "电话", "手机", "手机号"),
    "email": ("email", "e-mail", "email address", "邮箱"),
}
NAME_STARTS = ("my name is", "i am", "this is", "call me", "我叫", "我是", "名叫")
GIVEN = ("james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "alice", "emma", "anna", "kevin", "daniel", "elena", "caroline", "steven", "laura", "peter", "paul")
SURNAMES = ("smith", "johnson", "williams", "brown", "jones", "garcia", "miller", "davis", "wilson", "anderson", "taylor", "thomas", "moore", "martin", "lee", "walker", "hall", "young", "allen", "king", "wright", "scott", "green", "baker", "adams", "nelson", "carter", "mitchell", "bond", "mcintyre", "kaiser", "goodwin")
ZH_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
ZH_COMPOUND = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "司徒")
ORG_SUFFIXES = ("incorporated", "corporation", "holdings", "limited", "company", "studio", "group", "corp", "gmbh", "inc", "llc", "ltd", "plc", "co")
ZH_ORG_SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团公司", "工作室", "研究院", "集团", "公司", "大学", "医院", "银行", "学院")
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
DIRECTIONS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")
CITIES = ("new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "austin", "seattle", "denver", "boston", "miami", "portland", "atlanta", "bellevue", "san francisco")
ZH_PROVINCES = ("北京", "上海", "天津", "重庆", "广东", "江苏", "浙江", "山东", "四川", "湖北", "湖南", "河南", "河北", "福建", "安徽", "江西", "陕西", "辽宁", "吉林", "黑龙江", "云南", "贵州", "广西", "山西", "甘肃", "海南", "青海", "宁夏", "新疆", "西藏", "内蒙古")
ZH_CITIES = ("苏州", "杭州", "南京", "广州", "深圳", "武汉", "成都", "西安", "长沙", "郑州", "青岛", "厦门", "宁波", "无锡", "佛山", "东莞", "合肥", "济南")
ZH_PLATES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"
NOT_NAMES = ("the", "this", "that", "these", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "dear", "hello", "please", "thanks", "here", "note", "email", "address", "mobile", "number", "name", "phone")
DETERMINERS = ("the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "some", "any", "every", "each", "no")
LABELS |= {
    "bank_number": ("card number", "bank card", "account number", "银行卡号", "卡号", "账号"),
    "id_number": ("id number", "id card", "身份证号", "身份证", "证件号"),
    "num": ("verification code", "code", "pin", "验证码", "尾号"),
    "alnum": ("order number", "tracking number", "license key", "订单号", "单号"),
}
ORG_SUFFIX_STRENGTH = {
    **dict.fromkeys(("incorporated", "corporation", "limited", "llc", "plc", "gmbh", "inc", "corp", "ltd"), "hard"),
    **dict.fromkeys(("company", "co", "holdings", "group", "studio", "bank", "hospital"), "soft"),
    **dict.fromkeys(("university", "college", "institute"), "weak"),
    **dict.fromkeys(("股份有限公司", "有限责任公司", "有限公司", "集团公司"), "hard"),
    **dict.fromkeys(("集团", "工作室", "研究院"), "soft"),
    **dict.fromkeys(("公司", "大学", "医院", "银行", "学院"), "weak"),
}
ORG_NAMES = ("Google", "Microsoft", "Amazon", "Toyota", "Samsung", "华为", "腾讯", "阿里巴巴", "京东")
# Words that name the parts of an address; English keys stand after a road's or place's name and before a unit's.
EN_KEYS = {
    "road": ("street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "drive", "dr", "lane", "ln", "court", "ct", "place", "pl", "way", "parkway", "pkwy", "highway", "hwy", "terrace", "square"),
    "unit": ("apt", "apartment", "unit"),
    "suite": ("suite", "ste"),
    "room": ("room", "rm"),
    "building": ("building", "bldg", "tower"),
    "detail": ("floor", "fl"),
    "poi": ("homes", "flats", "hall", "offices", "plaza", "mall", "residences", "apartments", "towers"),
}
ZH_KEYS = {
    "province": ("省", "自治区"),
    "city": ("市",),
    "district": ("区", "县"),
    "subdistrict": ("街道", "镇", "乡", "村"),
    "road": ("路", "街", "大道", "巷", "弄", "胡同"),
    "number": ("号",),
    "poi": ("小区", "广场", "花园", "大厦", "国际", "公寓", "社区", "中心"),
    "building": ("号楼", "栋", "幢", "座"),
    "unit": ("单元",),
    "detail": ("层", "楼"),
    "room": ("室", "房", "户"),
}
ZH_WEAK_KEYS = ("detail", "room")
STATE_NAMES = dict(
    AL="Alabama", AK="Alaska", AZ="Arizona", AR="Arkansas", CA="California", CO="Colorado", CT="Connecticut", DE="Delaware", FL="Florida", GA="Georgia", HI="Hawaii", ID="Idaho", IL="Illinois", IN="Indiana", IA="Iowa", KS="Kansas", KY="Kentucky",
    LA="Louisiana", ME="Maine", MD="Maryland", MA="Massachusetts", MI="Michigan", MN="Minnesota", MS="Mississippi", MO="Missouri", MT="Montana", NE="Nebraska", NV="Nevada", NH="New Hampshire", NJ="New Jersey", NM="New Mexico", NY="New York",
    NC="North Carolina", ND="North Dakota", OH="Ohio", OK="Oklahoma", OR="Oregon", PA="Pennsylvania", RI="Rhode Island", SC="South Carolina", SD="South Dakota", TN="Tennessee", TX="Texas", UT="Utah", VT="Vermont", VA="Virginia", WA="Washington",
    WV="West Virginia", WI="Wisconsin", WY="Wyoming", DC="District of Columbia",
)
COUNTRY_ALIASES = {
    "united states": "United States", "united states of america": "United States", "USA": "United States", "United Kingdom": "United Kingdom", "UK": "United Kingdom", "China": "中国", "Germany": "Germany", "France": "France", "Spain": "Spain", "Belgium": "Belgium",
    "Canada": "Canada", "Italy": "Italy", "Japan": "日本", "中国": "中国", "美国": "United States", "英国": "United Kingdom", "法国": "France", "德国": "Germany", "日本": "日本",
}
ZH_CITY_PROVINCE = {"苏州": "江苏", "南京": "江苏", "无锡": "江苏", "杭州": "浙江", "宁波": "浙江", "广州": "广东", "深圳": "广东", "佛山": "广东", "东莞": "广东", "武汉": "湖北", "成都": "四川", "西安": "陕西", "长沙": "湖南", "郑州": "河南", "青岛": "山东", "济南": "山东", "厦门": "福建", "合肥": "安徽"}
ZH_NOT_NAMES = ("高兴", "高度", "高级", "黄金", "黄色", "白色", "金额", "金融", "方便", "方法", "方式", "马上", "任务", "任何", "时间", "于是", "向前", "和平", "万一", "石头", "成功", "江湖", "常常", "安全", "平安", "温度", "周末", "周围", "程序", "程度", "贺卡", "包括", "许多", "汪洋", "先生", "小姐", "女士", "老师", "经理")
ZH_NOT_ADDRESSES = ("知道", "报道", "道路", "味道", "频道", "市场", "城市", "区别", "区域", "地区", "省略", "节省", "网路", "思路", "线路", "街头", "房间", "座位", "号码", "楼主", "中心思想")
ZH_NOT_ORGS = ("有限的", "有限制", "集团军", "公司法")
ZH_STEMS = "甲乙丙丁戊己庚辛壬癸"
ZH_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
COPULAS = ("is", "are", "am", "是")
