"""English rules.  Everything in this module is a fixed value: the patterns (in their original dialect, see functions.dialect), their order, and the placeholders."""

# Placeholder of each tag.
PLACEHOLDERS = {
    "PHONE": "[Phone]",
    "EMAIL": "[Email]",
    "URL": "[URL]",
    "SECRET": "[Secret]",
    "ACCOUNT": "[Account]",
    "ADDRESS": "[Address]",
    "HANDLE": "[Handle]",
    "REF": "[Ref]",
    "TITLE": "[Title]",
    "NUMBER": "[Number]",
    "MONEY": "[Amount]",
    "COMPANY": "[Company]",
    "TERM": "[REDACTED]",
    "NAME": "[Name]",
}

# Order in which rules win, first to last.
PRIORITY = [
    "secret", "api_key_token", "bearer_token", "handle_label", "dob", "place_of_birth", "passport", "driver_license", "ssn", "ein", "national_id",
    "tax_id", "insurance_id", "intl_itin", "intl_nino", "intl_nhs", "intl_sin", "intl_tfn", "intl_abn", "uuid", "ip_label", "ip_address", "mac_label",
    "mac_address", "imei", "device_fingerprint", "account", "bank", "bank_routing_ids", "card_expiry", "card_security", "avs_data", "three_ds_status",
    "eci", "security_answer", "email", "url", "ref_label_multi_tail", "ref_label_nextline", "ref_label_tail", "ref_generic_multi_tail",
    "ref_generic_tail", "legal_ref_tail", "money_label", "money_negative", "money", "phone", "person_name", "person_name_inline",
    "person_name_plain_label", "person_name_title_line", "company_label", "company", "address_de_street", "address_de_postal",
    "address_en_inline_street", "address_en_street_line", "address_en_extra_block", "address_en_extra", "handle", "wallet_id", "tx_hash",
    "crypto_wallet", "number",
]

# Rules that cannot be switched off.
ALWAYS_ON = [
    "handle_label", "secret", "api_key_token", "bearer_token", "dob", "place_of_birth", "passport", "driver_license", "ssn", "ein", "national_id",
    "tax_id", "insurance_id", "intl_itin", "intl_nino", "intl_nhs", "intl_sin", "intl_tfn", "intl_abn", "uuid", "ip_label", "ip_address", "mac_label",
    "mac_address", "imei", "device_fingerprint", "money_label", "money_negative", "money", "account", "bank", "bank_routing_ids", "card_expiry",
    "card_security", "avs_data", "three_ds_status", "eci", "security_answer", "person_name", "person_name_inline", "person_name_plain_label",
    "person_name_title_line", "company_label", "address_en_inline_street", "address_en_street_line", "address_en_extra_block", "address_en_extra",
    "ref_label_multi_tail", "ref_label_nextline", "ref_label_tail", "ref_generic_multi_tail", "ref_generic_tail", "legal_ref_tail", "wallet_id",
    "tx_hash", "crypto_wallet",
]

# Key, tag, mode, flags, pattern.
RULES = [
    ("email", "EMAIL", "whole", "gi", r"\b[A-Z0-9._%+-]+[ \t]*@[ \t]*[A-Z0-9.-]+[ \t]*\.[ \t]*[A-Z]{2,}\b"),
    ("url", "URL", "whole", "giu", r"""\b(?:https?://|www\.)[^\s<>"'\n\r）)\]】]+"""),
    ("money_label", "MONEY", "prefix", "giu", r"((?:amount|total|subtotal|grand[ \t]*total|price|fee|fees|charge|charges|balance|paid|payment|refund|due|total[ \t]*due|net|gross|tax|vat)(?:[ \t]+\d{1,3}(?:[.,]\d{1,2})?[ \t]*%)?(?:[ \t]*[:：=][ \t]*|[ \t]+))((?:[€$£¥￥][ \t]*[-+−]?(?:\d{1,3}(?:[., \t]\d{3})+|\d{4,}|\d{1,3})(?:[.,]\d{2})?|\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b[ \t]*[-+−]?(?:\d{1,3}(?:[., \t]\d{3})+|\d{4,}|\d{1,3})(?:[.,]\d{2})?|[-+−]?(?:\d{1,3}(?:[., \t]\d{3})+|\d{4,}|\d{1,3})(?:[.,]\d{2})?[ \t]*\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b|[-+−]?(?:\d{1,3}(?:[., \t]\d{3})+|\d{4,}|\d{1,3})(?:[.,]\d{2})))(?![\dA-Za-z])"),
    ("money_negative", "MONEY", "whole", "giu", r"(?:[€$£¥￥][ \t]*[-−]\s*\d{1,3}(?:[., \t]\d{3})*(?:[.,]\d{2})?(?![\dA-Za-z])|[-−]\s*\d{1,3}(?:[., \t]\d{3})*(?:[.,]\d{2})?[ \t]*\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b(?![\dA-Za-z])|\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b[ \t]*[-−]\s*\d{1,3}(?:[., \t]\d{3})*(?:[.,]\d{2})?(?![\dA-Za-z]))"),
    ("money", "MONEY", "whole", "giu", r"(?:\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b[ \t]*[-+−]?(?:\d{1,3}(?:[., \t]\d{3})*|\d{4,})(?:[.,]\d{2})?(?![\dA-Za-z])|[-+−]?(?:\d{1,3}(?:[., \t]\d{3})*|\d{4,})(?:[.,]\d{2})?[ \t]*\b(?:EUR|USD|GBP|CHF|RMB|CNY|HKD)\b(?![\dA-Za-z])|[€$£¥￥][ \t]*[-+−]?(?:\d{1,3}(?:[., \t]\d{3})*|\d{4,})(?:[.,]\d{2})?(?![\dA-Za-z]))"),
    ("secret", "SECRET", "prefix", "giu", r"((?:password|passcode|pin|otp|2fa|verification[ \t]*code|security[ \t]*code|one[- \t]?time[ \t]*code|recovery[ \t]*code|backup[ \t]*code)[ \t]*[:：=][ \t]*)([^\n\r]{1,160})"),
    ("api_key_token", "SECRET", "prefix", "giu", r"((?:api[ \t]*key|x-api-key|access[ \t]*token|refresh[ \t]*token|token|auth[ \t]*token|client[ \t]*secret|secret[ \t]*key)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{8,300})"),
    ("bearer_token", "SECRET", "prefix", "giu", r"(\bauthorization[ \t]*[:：=][ \t]*bearer[ \t]+)([A-Za-z0-9._\-]{8,400})"),
    ("handle_label", "HANDLE", "prefix", "giu", r"((?:username|user[ \t]*id|login[ \t]*id|login|handle)[ \t]*(?:[:：=]|-)[ \t]*)(?![A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b)([A-Za-z0-9_@.\-]{3,80})"),
    ("dob", "SECRET", "prefix", "giu", r"((?:date[ \t]*of[ \t]*birth|dob)[ \t]*[:：=][ \t]*)(\d{4}[-/\.]\d{1,2}[-/\.]\d{1,2}|\d{1,2}/\d{1,2}/\d{4})"),
    ("place_of_birth", "SECRET", "prefix", "giu", r"((?:place[ \t]*of[ \t]*birth|pob|birthplace)[ \t]*[:：=][ \t]*)([^\n\r]{2,80})"),
    ("passport", "SECRET", "prefix", "giu", r"((?:passport(?:[ \t]*(?:no\.?|number))?)[ \t]*[:：=][ \t]*)([A-Z0-9][A-Z0-9\-]{4,22})"),
    ("driver_license", "SECRET", "prefix", "giu", r"((?:driver[’']?s[ \t]*license(?:[ \t]*(?:no\.?|number))?|driving[ \t]*licen[cs]e(?:[ \t]*(?:no\.?|number))?)[ \t]*[:：=][ \t]*)([A-Z0-9][A-Z0-9\-]{4,28})"),
    ("ssn", "SECRET", "prefix", "giu", r"((?:ssn|social[ \t]*security[ \t]*number)[ \t]*[:：=][ \t]*)(\d{3}-\d{2}-\d{4}|\d{9})"),
    ("ein", "SECRET", "prefix", "giu", r"((?:ein|employer[ \t]*identification[ \t]*number)[ \t]*[:：=][ \t]*)(\d{2}-\d{7})"),
    ("national_id", "SECRET", "prefix", "giu", r"((?:national[ \t]*id(?:[ \t]*(?:no\.?|number))?|id[ \t]*number)[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-_.]{3,40})"),
    ("tax_id", "SECRET", "prefix", "giu", r"((?:tax[ \t]*id|tax[ \t]*identification[ \t]*(?:no\.?|number)|tin)[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-]{4,32})"),
    ("insurance_id", "SECRET", "prefix", "giu", r"((?:insurance[ \t]*(?:id|no\.?|number)|policy[ \t]*(?:id|no\.?|number)|claim[ \t]*(?:id|no\.?|number)|member[ \t]*(?:id|no\.?|number)|membership[ \t]*(?:id|no\.?|number))[ \t]*[:：=][ \t]*)([A-Za-z0-9][A-Za-z0-9\-_.]{3,60})"),
    ("intl_itin", "SECRET", "prefix", "giu", r"((?:us[ \t]*)?itin[ \t]*[:：=][ \t]*)(9\d{2}[- \t]?\d{2}[- \t]?\d{4})"),
    ("intl_nino", "SECRET", "prefix", "giu", r"((?:uk[ \t]*)?nino[ \t]*[:：=][ \t]*)([A-Z]{2}[ \t]?\d{2}[ \t]?\d{2}[ \t]?\d{2}[ \t]?[A-D])"),
    ("intl_nhs", "SECRET", "prefix", "giu", r"((?:uk[ \t]*)?nhs[ \t]*number[ \t]*[:：=][ \t]*)(\d{3}[ \t]?\d{3}[ \t]?\d{4})"),
    ("intl_sin", "SECRET", "prefix", "giu", r"((?:ca[ \t]*)?sin[ \t]*[:：=][ \t]*)(\d{3}[ \t]?\d{3}[ \t]?\d{3})"),
    ("intl_tfn", "SECRET", "prefix", "giu", r"((?:au[ \t]*)?tfn[ \t]*[:：=][ \t]*)(\d{3}[ \t]?\d{3}[ \t]?\d{3})"),
    ("intl_abn", "SECRET", "prefix", "giu", r"((?:au[ \t]*)?abn[ \t]*[:：=][ \t]*)(\d{2}[ \t]?\d{3}[ \t]?\d{3}[ \t]?\d{3})"),
    ("uuid", "SECRET", "whole", "giu", r"\b([0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})\b"),
    ("ip_label", "SECRET", "prefix", "giu", r"((?:ip[ \t]*address|ipv4|ipv6)[ \t]*[:：=][ \t]*)((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})"),
    ("ip_address", "SECRET", "whole", "giu", r"\b((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4})\b"),
    ("mac_label", "SECRET", "prefix", "giu", r"((?:mac[ \t]*(?:address)?)[ \t]*[:：=][ \t]*)(\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b)"),
    ("mac_address", "SECRET", "whole", "giu", r"\b(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\b"),
    ("imei", "SECRET", "prefix", "giu", r"((?:imei)[ \t]*[:：=][ \t]*)(\d{14,16})"),
    ("device_fingerprint", "SECRET", "prefix", "giu", r"((?:device[ \t]*id|session[ \t]*id|fingerprint|user[ \t]*agent)[ \t]*[:：=][ \t]*)([^\n\r]{1,200})"),
    ("account", "ACCOUNT", "prefix", "giu", r"((?:account(?:[ \t]*number)?(?![ \t]*holder\b)(?![ \t]*statement\b)|routing[ \t]*number|sort[ \t]*code|iban|credit[ \t]*card|debit[ \t]*card|card[ \t]*number|name[ \t]*on[ \t]*card)(?:[ \t]*[:：=][ \t]*|[ \t]+))([A-Z]{2}\d{2}(?:[ \t]?[A-Z0-9]{2,5}){3,10}|(?:\d[ \t-]?){8,24}\d|[A-Za-z][A-Za-z \-'.]{3,60})(?=[ \t]*(?:[|·]|\n|\r|$))"),
    ("bank", "ACCOUNT", "prefix", "giu", r"((?:swift|swift[ \t]*code|bic|swift/bic)\b(?:[ \t]*[:：=][ \t]*|[ \t]+))([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)(?=[ \t]*(?:[|·]|\n|\r|$))"),
    ("bank_routing_ids", "ACCOUNT", "prefix", "giu", r"((?:bank[ \t]*name|branch[ \t]*code|clearing[ \t]*(?:number|no\.?)|transit[ \t]*number|bsb|aba[ \t]*(?:number|routing[ \t]*number)?|aba)[ \t]*[:：=][ \t]*)([0-9][0-9 \t-]{2,24}[0-9])"),
    ("card_expiry", "SECRET", "prefix", "giu", r"((?:exp(?:iry|iration)?(?:[ \t]*date)?|valid[ \t]*thru|valid[ \t]*through)[ \t]*[:：=][ \t]*)(\d{2}[ \t]*/[ \t]*\d{2,4}|\d{2}[ \t]*-[ \t]*\d{2,4}|\d{4}[ \t]*-[ \t]*\d{2})"),
    ("card_security", "SECRET", "prefix", "giu", r"((?:cvv|cvc)[ \t]*[:：=][ \t]*)(\d{3,4})"),
    ("avs_data", "SECRET", "prefix", "giu", r"((?:avs[ \t]*data)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{1,40})"),
    ("three_ds_status", "SECRET", "prefix", "giu", r"((?:3-?d[ \t]*secure|3ds)[ \t]*(?:status)?[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{1,40})"),
    ("eci", "SECRET", "prefix", "giu", r"((?:eci)[ \t]*[:：=][ \t]*)(\d{2})"),
    ("security_answer", "SECRET", "prefix", "giu", r"((?:security[ \t]*answer)[ \t]*[:：=][ \t]*)([^\n\r]{1,160})"),
    ("phone", "PHONE", "prefix", "giu", r"((?:phone|mobile|tel|whatsapp|telegram|signal|fax|contact)[ \t]*[:：=]?[ \t]*)([+＋]?[ \t]*[\d][\d \t().-]{5,}\d)\b"),
    ("person_name", "NAME", "prefix", "giu", r"((?:customer[ \t]*name|account[ \t]*holder|account[ \t]*manager|manager|agent|contact[ \t]*person|support[ \t]*agent|sales[ \t]*manager|recipient|name[ \t]*on[ \t]*card|to|attn\.?|attention)[ \t]*[:：=][ \t]*)((?:(?:mr|mrs|ms|miss|dr|prof)\.?[ \t]+)?[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+(?:[ \t]+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+)*)"),
    ("person_name_inline", "NAME", "prefix", "giu", r"((?:customer[ \t]*name|account[ \t]*holder|account[ \t]*manager|manager|agent|contact(?:[ \t]*person)?|support[ \t]*agent|sales[ \t]*manager|recipient|name[ \t]*on[ \t]*card|to|attn\.?|attention)(?:[ \t]*[:：=][ \t]*))(((?:mr|mrs|ms|miss|dr|prof)\.?[ \t]+)?(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40})(?:[ \t]+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40}){0,3})(?=[ \t]*(?:[|·]|\n|\r|$))"),
    ("person_name_plain_label", "NAME", "prefix", "giu", r"((?<!bank[ \t])(?<!company[ \t])(?<!product[ \t])(?<!system[ \t])(?<!service[ \t])(?:name)(?:[ \t]*[:：=][ \t]*))(((?:mr|mrs|ms|miss|dr|prof)\.?[ \t]+)?(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40})(?:[ \t]+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40}){0,3})(?=[ \t]*(?:[|·]|\n|\r|$))"),
    ("person_name_title_line", "NAME", "prefix", "gmiu", r"^((?:mr|mrs|ms|miss|dr|prof)\.?\s+)((?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40})(?:[ \t]+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]{1,40}){0,3})[ \t]*$"),
    ("company_label", "COMPANY", "prefix", "giu", r"((?:Company(?:[ \t]*Name)?|Supplier|Legal[ \t]*Entity|Registered[ \t]*Company|Billing[ \t]*Company)[ \t]*[:：=][ \t]*)([^\n\r]+)"),
    ("company", "COMPANY", "company", "giu", r"\b(?<name>[A-Za-z][A-Za-z0-9&.\- ]{1,60}?)[ \t]+(?<legal>LLC|L\.?L\.?C\.?|Ltd\.?|Limited|Inc\.?|Incorporated|Corp\.?|Corporation|PLC|LLP)\b"),
    ("address_de_street", "ADDRESS", "prefix", "giu", r"((?:address|shipping[ \t]*address|billing[ \t]*address|street[ \t]*address|mailing[ \t]*address)[ \t]*[:：=][ \t]*)([^\n\r]+)"),
    ("address_de_postal", "ADDRESS", "prefix", "giu", r"((?:zip(?:[ \t]*code)?|postal[ \t]*code|postcode)[ \t]*[:：=][ \t]*)(\d{5}(?:-\d{4})?|[A-Z]\d[A-Z][ \t]?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]?[ \t]?\d[A-Z]{2}|\d{4}|[A-Z0-9][A-Z0-9\- ]{2,9}[A-Z0-9])"),
    ("address_en_street_line", "ADDRESS", "whole", "gmiu", r"^(?:[A-Za-z0-9.'’\-]+\s+){1,5}(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|way|boulevard|blvd\.?|court|ct\.?|place|pl\.?)\s+\d{1,5}[A-Za-z]?[ \t]*$"),
    ("address_en_inline_street", "ADDRESS", "whole", "giu", r"\b\d{1,5}[A-Za-z]?(?:-\d{1,5})?[ \t]+(?:[A-Za-z0-9.'’\-]+[ \t]+){0,6}(?:street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|way|parkway|pkwy\.?|court|ct\.?|place|pl\.?|square|sq\.?|highway|hwy\.?|terrace|ter\.?|crescent|cres\.?|close|cl\.?|gardens?|gdns?\.?|mews|row|alley|aly\.?)\b"),
    ("address_en_extra_block", "ADDRESS", "whole", "giu", r"\b(?:suite|ste\.?|apt|apartment|unit|floor|fl\.?|room|rm\.?|flat|level)\b(?:[ \t]*(?:#|no\.?|number)?[ \t]*[:：-]?[ \t]*)(?=[A-Za-z0-9.\-]{1,12}\b)(?=[A-Za-z0-9.\-]*\d)[A-Za-z0-9.\-]{1,12}\b"),
    ("address_en_extra", "ADDRESS", "whole", "giu", r"\b(?:apt|apartment|unit|suite|ste\.?|floor|fl\.?|room|rm\.?|flat|level|building|bldg\.?|dept|department)\b(?:[ \t]+#?[ \t]*|#[ \t]*)(?=[A-Za-z0-9.\-]{1,12}\b)(?=[A-Za-z0-9.\-]*\d)[A-Za-z0-9.\-]{1,12}\b"),
    ("ref_generic_multi_tail", "REF", "whole", "gu", r"\b(?!ERR-)(?!SKU:)([A-Z]{2,6}(?:-[A-Z0-9]{1,12}){1,6}-\d{4,}(?:-\d{4,})+)\b"),
    ("ref_label_multi_tail", "REF", "prefix", "giu", r"((?:(?:application|order|invoice|reference|ref\.?|case|ticket|request|customer|account)[ \t]*(?:id|no\.?|number)?[ \t]*(?:[:：=]|-)[ \t]*)(?!ERR-)(?!SKU:))((?:[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,8}?[-_.]\d{4,}(?:[-_.]\d{4,})+))"),
    ("ref_label_nextline", "REF", "prefix", "giu", r"((?:(?:application|order|invoice|reference|ref\.?|case|ticket|request|customer|account)[ \t]*(?:id|no\.?|number)?[ \t]*[:：=][ \t]*[\r]?\n[ \t]*)(?!ERR-)(?!SKU:))((?:[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,8}[-_.]\d{4,}))"),
    ("ref_label_tail", "REF", "prefix", "giu", r"((?:(?:application|order|invoice|reference|ref\.?|case|ticket|request|customer|account)[ \t]*(?:id|no\.?|number)?[ \t]*(?:[:：=]|-)[ \t]*)(?!ERR-)(?!SKU:))((?:[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,8}[-_.]\d{4,}))"),
    ("ref_generic_tail", "REF", "whole", "gu", r"\b(?!ERR-)(?!SKU:)([A-Z]{2,6}(?:-[A-Z0-9]{1,12}){1,6}-\d{5,})\b"),
    ("legal_ref_tail", "REF", "prefix", "giu", r"((?:(?:contract[ \t]*number|claim[ \t]*reference|legal[ \t]*case[ \t]*ref)[ \t]*[:：=][ \t]*)(?!ERR-)(?!SKU:))((?:[A-Za-z0-9\[\]]+(?:[-_.][A-Za-z0-9\[\]]+){0,8}[-_.]\d{4,}))"),
    ("handle", "HANDLE", "whole", "g", r"@[A-Za-z0-9_]{2,32}\b"),
    ("wallet_id", "SECRET", "prefix", "giu", r"((?:wallet[ \t]*id)[ \t]*[:：=][ \t]*)([A-Za-z0-9._\-]{3,80})"),
    ("tx_hash", "SECRET", "prefix", "giu", r"((?:transaction[ \t]*hash|tx[ \t]*hash|txn[ \t]*hash)[ \t]*[:：=][ \t]*)(0x[0-9a-f]{16,128})"),
    ("crypto_wallet", "SECRET", "prefix", "giu", r"((?:btc|eth)[ \t]*[:：=][ \t]*)((?:bc1)[0-9a-z]{25,90}|[13][A-HJ-NP-Za-km-z1-9]{25,34}|0x[a-f0-9]{40})"),
    ("number", "NUMBER", "whole", "g", r"\b\d[\d \t-]{6,28}\d\b"),
]
