"""Chinese rules.  Everything in this module is a fixed value: the patterns (in their original dialect, see functions.dialect), their order, and the placeholders."""

# Placeholder of each tag.
PLACEHOLDERS = {
    "PHONE": "【电话】",
    "EMAIL": "【邮箱】",
    "URL": "【网址】",
    "SECRET": "【敏感】",
    "ACCOUNT": "【账号】",
    "ADDRESS": "【地址】",
    "HANDLE": "【账号名】",
    "REF": "【编号】",
    "TITLE": "【称谓】",
    "NUMBER": "【数字】",
    "MONEY": "【金额】",
    "COMPANY": "【公司】",
    "TERM": "【遮盖】",
    "NAME": "【姓名】",
}

# Order in which rules win, first to last.
PRIORITY = [
    "secret", "security_answer", "api_key_token_zh", "secret_inline_zh", "dob", "place_of_birth", "id_card", "id_card_inline_zh", "passport",
    "passport_inline_zh", "driver_license", "driver_license_inline_zh", "license_plate", "license_plate_inline_zh", "tax_id_zh", "ip_label",
    "ip_address", "mac_label", "mac_address", "imei", "device_fingerprint", "uuid", "account", "account_cn_inline", "bank", "bank_routing_ids",
    "card_expiry", "card_security", "email", "url", "handle_label", "cust_id", "ref_label_tail", "ref_inline_zh", "money_label",
    "money_label_currency_zh", "money_cn_inline_label", "money", "phone", "company_label_inline_zh", "company_label_inline_zh_no_colon", "company",
    "company_block", "person_name", "person_name_address_block", "address_cn_block_multiline", "address_inline_zh", "address_cn", "address_cn_block",
    "wallet_id", "tx_hash", "crypto_wallet", "handle", "number",
]

# Rules that cannot be switched off.
ALWAYS_ON = [
    "handle_label", "cust_id", "ref_label_tail", "ref_inline_zh", "address_cn_block_multiline", "address_inline_zh", "address_cn", "address_cn_block",
    "secret", "security_answer", "api_key_token_zh", "secret_inline_zh", "dob", "place_of_birth", "id_card", "id_card_inline_zh", "passport",
    "passport_inline_zh", "driver_license", "driver_license_inline_zh", "license_plate", "license_plate_inline_zh", "tax_id_zh", "ip_label",
    "ip_address", "mac_label", "mac_address", "imei", "device_fingerprint", "uuid", "account", "account_cn_inline", "bank", "bank_routing_ids",
    "card_expiry", "card_security", "money_label", "money_label_currency_zh", "money_cn_inline_label", "money", "company_label_inline_zh",
    "company_label_inline_zh_no_colon", "company", "company_block", "person_name", "person_name_address_block", "wallet_id", "tx_hash",
    "crypto_wallet",
]

# Key, tag, mode, flags, pattern.
RULES = [
    ("email", "EMAIL", "whole", "gi", r"\b[A-Z0-9._%+-]+[ \t]*@[ \t]*[A-Z0-9.-]+[ \t]*\.[ \t]*[A-Z]{2,}\b"),
    ("url", "URL", "whole", "giu", r"""\b(?:https?://|www\.)[^\s<>"'）)\]】]+"""),
    ("secret", "SECRET", "prefix", "giu", r"((?:密码|口令|登录密码|支付密码|PIN|验证码|校验码|动态码|短信验证码|OTP|2FA|口令码|安全码|授权码)[ \t]*[:：=][ \t]*)([^\n\r]{1,120})"),
    ("security_answer", "SECRET", "prefix", "giu", r"((?:安全答案|密保答案|回答|答案|security[ \t]*answer|answer)[ \t]*[:：=][ \t]*)([^\n\r]{1,160})"),
    ("api_key_token_zh", "SECRET", "prefix", "giu", r"((?:接口密钥|API[ \t]*Key|Api[ \t]*Key|访问令牌|Access[ \t]*Token|刷新令牌|Refresh[ \t]*Token|令牌|Token)[ \t]*[:：=]?[ \t]*)([A-Za-z0-9._\-]{8,300})"),
    ("secret_inline_zh", "SECRET", "prefix", "giu", r"((?:接口密钥|API[ \t]*Key|Access[ \t]*Token|接[ \t]*口密钥|会[ \t]*话ID|会话ID|Session[ \t]*ID|设[ \t]*备ID|设备ID|Device[ \t]*ID|钱[ \t]*包地址|钱包地址|交[ \t]*易哈希|交易哈希|交易Hash)[ \t:：=]*)(?:\r?\n[ \t]*)?(0x[0-9a-f]{16,128}|sk_[A-Za-z0-9._\-]{8,300}|sess_[A-Za-z0-9._\-]{4,300}|device_[A-Za-z0-9._\-]{4,300}|[A-Za-z0-9._\-]{6,300})"),
    ("dob", "SECRET", "prefix", "giu", r"((?:出生日期(?:（中文）)?|出生年月|生日|DOB|Date[ \t]*of[ \t]*Birth)[ \t]*[:：=][ \t]*)(\d{4}[-/\.]\d{1,2}[-/\.]\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日)"),
    ("place_of_birth", "SECRET", "prefix", "giu", r"((?:出生地|籍贯|出生地点|Birth[ \t]*Place|Place[ \t]*of[ \t]*Birth)[ \t]*[:：=][ \t]*)([^\n\r]{2,80})"),
    ("id_card", "SECRET", "prefix", "giu", r"((?:身份证号|居民身份证|身份证号码|公民身份号码)[ \t]*[:：=][ \t]*)(\d{17}[\dXx])\b"),
    ("id_card_inline_zh", "SECRET", "prefix", "giu", r"((?:身份证号|居民身份证|身份证号码|公民身份号码)[ \t]*)(\d{17}[\dXx])\b"),
    ("passport", "SECRET", "prefix", "giu", r"((?:护照号|护照号码|Passport(?:[ \t]*No\.?|[ \t]*Number)?)[ \t]*[:：=][ \t]*)([A-Z0-9][A-Z0-9\-]{4,22})"),
    ("passport_inline_zh", "SECRET", "prefix", "giu", r"((?:护照号|护照号码|Passport(?:[ \t]*No\.?|[ \t]*Number)?)[ \t]*)([A-Z0-9][A-Z0-9\-]{4,22})"),
    ("driver_license", "SECRET", "prefix", "giu", r"((?:驾驶证号|驾驶证号码|Driver[’']?s[ \t]*License(?:[ \t]*No\.?|[ \t]*Number)?)[ \t]*[:：=][ \t]*)(\d{17}[\dXx]|(?=[^\n\r]*\d)[^\n\r]{4,40})"),
    ("driver_license_inline_zh", "SECRET", "prefix", "giu", r"((?:驾驶证号|驾驶证号码|Driver[’']?s[ \t]*License(?:[ \t]*No\.?|[ \t]*Number)?)[ \t]*)(\d{17}[\dXx]|(?=[^\n\r]*\d)[A-Za-z0-9\-]{4,40})"),
    ("license_plate", "SECRET", "prefix", "giu", r"((?:车牌号|车牌号码|号牌号码|车牌|号牌)[ \t]*[:：=][ \t]*)([\u4E00-\u9FFF][A-Z][A-Z0-9]{5,6})\b"),
    ("license_plate_inline_zh", "SECRET", "prefix", "giu", r"((?:车牌号|车牌号码|号牌号码|车牌|号牌)[ \t]*)([\u4E00-\u9FFF][A-Z][A-Z0-9]{5,6})\b"),
    ("tax_id_zh", "SECRET", "prefix", "giu", r"((?:税号|纳税人识别号|统一社会信用代码)[ \t]*[:：=][ \t]*)([A-Z0-9][A-Z0-9\-]{7,31})"),
    ("cust_id", "REF", "prefix", "giu", r"((?:Customer[ \t]*ID|客户号|客户ID)[ \t]*[:：=][ \t]*CUST-)(\d{6,})"),
    ("ref_label_tail", "REF", "prefix", "giu", r"((?:申请编号|参考编号|订单号|单号|合同号|发票号|编号|工单号|票据号|客户号|索赔参考号|法律案件号|Case[ \t]*ID|Ticket[ \t]*No\.?|Application[ \t]*ID|Order[ \t]*ID|Invoice[ \t]*No\.?|Reference)[ \t]*[:：=][ \t]*)((?!ERR-)(?!SKU:)[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,10}[-_.]\d{4,})"),
    ("ref_inline_zh", "REF", "prefix", "giu", r"((?:合同编号|补充协议编号|参考编号|订单号|发票号|申请编号|工单号|票据号|法律案件号|索赔参考号|客户号|合同号)[ \t]*)((?!ERR-)(?!SKU:)[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,10}[-_.]\d{4,})"),
    ("account", "ACCOUNT", "prefix", "giu", r"((?:银行账号|銀行賬號|账号|賬號|收款账号|收款帳號|账户|帳戶|开户账号|開戶賬號|银行卡号|卡号|信用卡|信用卡号|信用卡號|card[ \t]*number|credit[ \t]*card|对公账户|對公賬戶|IBAN|Account[ \t]*Number)[ \t]*[:：=]?[ \t]*)([A-Z]{2}\d{2}[\d \t-]{10,40}|\d[\d \t-]{6,40}\d)"),
    ("account_cn_inline", "ACCOUNT", "prefix", "giu", r"((?:对公账户|收款账号|银行账号|银行卡号|联行号|清算号|分行号|支行号|路由号)[ \t:：=]*)(?:\r?\n[ \t]*)?(\d[\d \t-]{6,40}\d)"),
    ("bank", "ACCOUNT", "prefix", "giu", r"((?:开户银行|開戶銀行|银行|銀行|BIC|SWIFT|Swift[ \t]*Code)[ \t]*[:：=]?[ \t]*)([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?|\d{6,12})"),
    ("bank_routing_ids", "ACCOUNT", "prefix", "giu", r"((?:联行号|清算号|分行号|支行号|行号|路由号|routing[ \t]*number|aba|bsb|transit[ \t]*number|clearing[ \t]*(?:number|no\.?)|branch[ \t]*code)[ \t]*[:：=][ \t]*)([0-9][0-9 \t-]{2,24}[0-9])"),
    ("card_expiry", "SECRET", "prefix", "giu", r"((?:有效期|到期|exp(?:iry|iration)?(?:[ \t]*date)?|valid[ \t]*thru|valid[ \t]*through)[ \t]*[:：=][ \t]*)(\d{2}[ \t]*/[ \t]*\d{2,4}|\d{2}[ \t]*-[ \t]*\d{2,4}|\d{4}[ \t]*-[ \t]*\d{2})"),
    ("card_security", "SECRET", "prefix", "giu", r"((?:CVV|CVC|安全码|校验码)[ \t]*[:：=][ \t]*)(\d{3,4})"),
    ("phone", "PHONE", "phone", "giu", r"((?:联系方式|联系电话|电话|手機|手机|tel|telefon|phone|mobile|handy)[ \t]*[:：=]?[ \t]*)([+＋]?[ \t]*\d[\d \t().-]{5,}\d)\b|(\b(?:[+＋][ \t]*\d{1,3}|00[ \t]*\d{1,3})[\d \t().-]{6,}\d\b)"),
    ("person_name", "NAME", "prefix", "gmu", r"((?:姓名|收件人|联系人|Name|Recipient)[ \t]*[:：=][ \t]*)(?![^\n\r]*(?:集团有限公司|股份有限公司|有限责任公司|有限公司|集团|公司|分公司|事务所))((?:(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)[ \t]*)?[\u4E00-\u9FFF]{2,6}|(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40})(?:[ \t]+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{0,3}){0,3})"),
    ("person_name_address_block", "NAME", "prefix", "gmu", r"((?:账单地址|帳單地址|收货地址|收貨地址|办公地址|辦公地址|通信地址|聯絡地址|联系地址|聯繫地址|地址)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,4})(?![^\n\r]*(?:集团有限公司|股份有限公司|有限责任公司|有限公司|集团|公司|分公司|事务所))((?:【姓名】|[\u4E00-\u9FFF]{2,6}))(?=[ \t]*(?:\r?\n))"),
    ("handle_label", "HANDLE", "prefix", "giu", r"((?:用户名|用[ \t]*户[ \t]*名|用户ID|用户[ \t]*ID|用户|登录账号|登[ \t]*录[ \t]*账[ \t]*号|账号名|账[ \t]*号[ \t]*名|账号|支付账号|支付账户|微信号|WeChat[ \t]*ID|wxid|User[ \t]*ID)[ \t]*[:：=][ \t]*)([A-Za-z0-9_@.\-]{3,80})"),
    ("address_cn", "ADDRESS", "address_cn_partial", "giu", r"((?:地址|住址|办公地址|通信地址|收货地址|收件地址|联系地址|联系住址|居住地址|单位地址|公司地址|注册地址|签署地址|履约地址)[ \t]*[:：=][ \t]*)([^\n\r]+)"),
    ("address_cn_block", "ADDRESS", "address_cn_partial", "giu", r"((?:账单地址|帳單地址|收货地址|收貨地址|收件地址|办公地址|辦公地址|通信地址|聯系地址|联系地址|公司地址|注册地址|签署地址|履约地址|地址)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,4}(?:(?:【姓名】|[\u4E00-\u9FFF]{2,6})[ \t]*(?:\r?\n[ \t]*){1,4})?)(?=[^\n\r]{2,200})((?:.*?(?:路|街|道|大道|巷|弄|里|坊|胡同))\d{1,6}(?:-\d{1,4})?[ \t]*号[^\n\r]{0,80})"),
    ("address_cn_block_multiline", "ADDRESS", "address_cn_partial", "giu", r"((?:账单地址|帳單地址|收货地址|收貨地址|收件地址|办公地址|辦公地址|通信地址|聯系地址|联系地址|公司地址|注册地址|签署地址|履约地址|地址)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,3}(?:(?:【姓名】|[\u4E00-\u9FFF]{2,6})[ \t]*(?:\r?\n[ \t]*){1,3})?)([^\n\r]{2,200}(?:(?:路|街|道|大道|巷|弄|里|坊|胡同)[^\n\r]{0,40}\d{1,6}(?:-\d{1,4})?[ \t]*号[^\n\r]{0,80}))"),
    ("address_inline_zh", "ADDRESS", "address_cn_partial", "giu", r"((?:上海市|北京市|天津市|重庆市|香港特别行政区|澳门特别行政区|[\u4E00-\u9FFF]{2,8}省[\u4E00-\u9FFF]{2,20}市|[\u4E00-\u9FFF]{2,20}市[\u4E00-\u9FFF]{2,20}(?:区|县|镇))[\u4E00-\u9FFF0-9A-Za-z\-]{0,80}?(?:路|街|道|大道|巷|弄|里|坊|胡同)[^\n\r]{0,40}?\d{1,6}(?:-\d{1,4})?[ \t]*号[^\n\r]{0,80})"),
    ("money_label", "MONEY", "prefix", "giu", r"((?:金额|合计|总计|小计|应付|实付|已付|支付金额|付款金额|收款金额|退款金额|余额|费用|手续费|服务费|税额|税费|增值税|合同总金额|首付款|尾款|金额合计|基础服务包|高级功能模块|实施费用|售后支持|付款|VAT|Amount|Total|Subtotal|Balance|Paid|Payment|Refund|Due|Net|Gross)[ \t]*[:：=][ \t]*)((?:[-+−]?(?:\d{1,3}(?:[, \t]\d{3})+|\d+)(?:\.\d{1,2})?))"),
    ("money_label_currency_zh", "MONEY", "prefix", "giu", r"((?:人民币|CNY|RMB|USD|EUR)[ \t]*[:：=][ \t]*)([-+−]?(?:\d{1,3}(?:[,\.\t ]\d{3})+|\d+)(?:[.,]\d{1,2})?)"),
    ("money_cn_inline_label", "MONEY", "prefix", "giu", r"((?:基础服务包|高级功能模块|实施费用|售后支持|首付款|尾款|合同总金额|服务费|手续费|增值税)[ \t]*)([-+−]?(?:\d{1,3}(?:[, \t]\d{3})+|\d+)(?:\.\d{1,2})?)"),
    ("money", "MONEY", "whole", "giu", r"(?:\b(?:人民币|CNY|RMB)\b[ \t]*[-+−]?(?:\d{1,3}(?:[, \t]\d{3})+|\d+)(?:\.\d{1,2})?[ \t]*(?:元)?|[¥￥][ \t]*[-+−]?(?:\d{1,3}(?:[, \t]\d{3})+|\d+)(?:\.\d{1,2})?|\b[-+−]?(?:\d{1,3}(?:[, \t]\d{3})+|\d+)(?:\.\d{1,2})?[ \t]*元|\bUSD\b[ \t]*\$?[ \t]*[-+−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?|\$[ \t]*[-+−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?|€[ \t]*[-+−]?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{2})?|\b[-+−]?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{2})?[ \t]*€)"),
    ("company_label_inline_zh", "COMPANY", "prefix", "gmu", r"((?:公司名称|公司名稱|单位名称|單位名稱|供应商|供應商|开票方|開票方|收款方|付款方|法务顾问单位|项目服务机构|項目服務機構|开户名|账户名|帳戶名|開戶名|甲方|乙方|发货方)[ \t]*[:：=][ \t]*)([\u4E00-\u9FFF][\u4E00-\u9FFF0-9（）()·&\-\s]{1,80}?(?:集团有限公司|股份有限公司|有限责任公司|有限公司|分公司|事务所|中心|集团|公司))"),
    ("company_label_inline_zh_no_colon", "COMPANY", "prefix", "gmu", r"((?:开户名|账户名|帳戶名|開戶名|公司名称|公司名稱|单位名称|單位名稱|项目服务机构|項目服務機構|法务顾问单位|发货方|甲方|乙方)[ \t]*)([\u4E00-\u9FFF][\u4E00-\u9FFF0-9（）()·&\-\s]{1,80}?(?:集团有限公司|股份有限公司|有限责任公司|有限公司|分公司|事务所|中心|集团|公司))"),
    ("company", "COMPANY", "company", "gu", r"(?<name>[\u4E00-\u9FFF][\u4E00-\u9FFF0-9（）()·&\-\s]{1,60}?)(?<legal>集团有限公司|股份有限公司|有限责任公司|有限公司|分公司|事务所|集团|公司)(?=$|[^\u4E00-\u9FFF])"),
    ("company_block", "COMPANY", "prefix", "gmu", r"((?:开票方|開票方|收款方|付款方|商户|商戶|供应商|供應商|公司名称|公司名稱|单位名称|單位名稱|开户名|账户名|帳戶名|開戶名)[ \t]*[:：=]?[ \t]*(?:\r?\n[ \t]*){1,4})([\u4E00-\u9FFF][\u4E00-\u9FFF0-9（）()·&\-\s]{1,60}?(?:集团有限公司|股份有限公司|有限责任公司|有限公司|分公司|事务所|中心|集团|公司))"),
    ("ip_label", "SECRET", "prefix", "giu", r"((?:IP(?:[ \t]*Address)?|IPv4|IPv6|IP地址)[ \t]*[:：=][ \t]*)((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})"),
    ("ip_address", "SECRET", "whole", "giu", r"\b((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})\b"),
    ("mac_label", "SECRET", "prefix", "giu", r"((?:MAC(?:[ \t]*Address)?|MAC地址)[ \t]*[:：=][ \t]*)(\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b)"),
    ("mac_address", "SECRET", "whole", "giu", r"\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b"),
    ("imei", "SECRET", "prefix", "giu", r"((?:IMEI)[ \t]*[:：=][ \t]*)(\d{14,16})"),
    ("device_fingerprint", "SECRET", "prefix", "giu", r"((?:设备ID|Device[ \t]*ID|会话ID|Session[ \t]*ID|指纹|Fingerprint|User-?Agent|UA)[ \t]*[:：=][ \t]*)([^\n\r]{1,220})"),
    ("uuid", "SECRET", "whole", "giu", r"\b([0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})\b"),
    ("wallet_id", "SECRET", "prefix", "giu", r"((?:Wallet[ \t]*ID|钱包ID|钱包编号)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{3,80})"),
    ("tx_hash", "SECRET", "prefix", "giu", r"((?:Transaction[ \t]*Hash|TX[ \t]*Hash|交易哈希|交易Hash)[ \t]*[:：=][ \t]*)(0x[0-9a-f]{16,128})"),
    ("crypto_wallet", "SECRET", "prefix", "giu", r"((?:BTC|比特币|ETH|以太坊)[ \t]*[:：=][ \t]*)((?:bc1)[0-9a-z]{25,90}|[13][A-HJ-NP-Za-km-z1-9]{25,34}|0x[a-f0-9]{40})"),
    ("handle", "HANDLE", "whole", "g", r"@[A-Za-z0-9_]{2,32}\b"),
    ("number", "NUMBER", "whole", "g", r"\b\d[\d \t-]{6,28}\d\b"),
]
