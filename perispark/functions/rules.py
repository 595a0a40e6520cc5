"""Fixed values of the rules: names, patterns and weights that results depend on."""

# port -> service
SERVICES = {
    80: "http", 443: "https", 22: "ssh", 21: "ftp", 25: "smtp", 587: "submission", 3306: "mysql", 5432: "postgresql",
    6379: "redis", 8080: "http-alt", 8443: "https-alt", 23: "telnet", 445: "smb", 3389: "rdp", 5900: "vnc",
    9200: "elasticsearch", 27017: "mongodb", 11211: "memcached", 2375: "docker-api", 6443: "kubernetes-api",
    389: "ldap", 636: "ldaps", 1433: "mssql", 161: "snmp",
}
BANNER_PORTS = (21, 22, 23, 25, 587, 3306, 5900, 6379, 9200, 11211, 27017, 2375, 6443, 389, 636, 1433, 161)
LEGACY_PORTS = (80, 443, 22, 21, 25, 587, 3306, 5432, 6379, 8080, 8443)

EU = ("AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL",
    "PT", "RO", "SE", "SI", "SK")

# nameserver host suffix -> operator, in order
OPERATORS = (
    ("ns.infomaniak.ch", "Infomaniak"), ("cloudflare.com", "Cloudflare"), ("infomaniak.ch", "Infomaniak"),
    ("hostpoint.ch", "Hostpoint"), ("hetzner.com", "Hetzner"), ("hetzner.de", "Hetzner"),
    ("registrar-servers.com", "Namecheap"), ("ui-dns.biz", "IONOS"), ("ui-dns.com", "IONOS"), ("ui-dns.de", "IONOS"),
    ("ui-dns.org", "IONOS"), ("domaincontrol.com", "GoDaddy"), ("azure-dns.com", "Azure DNS"), ("azure-dns.net", "Azure DNS"),
    ("azure-dns.org", "Azure DNS"), ("azure-dns.info", "Azure DNS"), ("googledomains.com", "Google"), ("google.com", "Google"),
    ("nsone.net", "NS1"), ("ultradns.net", "UltraDNS"), ("ultradns.com", "UltraDNS"), ("ultradns.org", "UltraDNS"),
    ("worldnic.com", "Network Solutions"), ("name.com", "Name.com"), ("dnsmadeeasy.com", "DNS Made Easy"), ("dnsimple.com", "DNSimple"),
    ("he.net", "Hurricane Electric"), ("bind.ch", "Switch"), ("switch.ch", "Switch"), ("metaname.net", "Metaname"),
    ("stackpathdns.com", "Stackpath"), ("dynect.net", "Dyn/Oracle"), ("nine.ch", "Nine"), ("hosteurope.de", "HostEurope"),
    ("eurodns.com", "EuroDNS"), ("active24.com", "Active24"), ("mydomain.com", "MyDomain"), ("netsolcorp.com", "Network Solutions"),
    ("verisigndns.com", "Verisign"), ("akamaiedge.net", "Akamai"), ("akam.net", "Akamai"),
)

CANTONS = (
    "bs", "zh", "be", "ag", "sg", "lu", "ti", "vd", "ge", "vs", "fr", "so", "tg", "gr", "ne", "sz", "zg", "gl", "nw", "ow", "ur", "ai",
    "ar", "sh", "bl", "ju",
)
# keyword -> sector, subsector, confidence, in order
SECTORS = (
    ("kantonalbank", "finance", "banking", 0.9), ("sparkasse", "finance", "banking", 0.8), ("bank", "finance", "banking", 0.7),
    ("credit", "finance", "banking", 0.65), ("finanz", "finance", "banking", 0.65), ("versicherung", "finance", "insurance", 0.75),
    ("insurance", "finance", "insurance", 0.7), ("pharma", "pharma", "", 0.7), ("biotech", "pharma", "", 0.7),
    ("klinik", "healthcare", "", 0.75), ("spital", "healthcare", "", 0.8), ("hospital", "healthcare", "", 0.75),
    ("medizin", "healthcare", "", 0.6), ("anwalt", "legal", "", 0.65), ("advokat", "legal", "", 0.75), ("notariat", "legal", "", 0.8),
    ("law", "legal", "", 0.5), ("schule", "education", "", 0.65), ("hochschule", "education", "", 0.8),
    ("universitaet", "education", "", 0.85), ("eth.ch", "education", "", 0.95), ("shop", "retail", "", 0.5),
    ("boutique", "retail", "", 0.55), ("news", "media", "", 0.5), ("zeitung", "media", "", 0.7),
    ("gemeinde", "government", "", 0.8), ("kanton", "government", "", 0.8), ("admin.ch", "government", "", 0.95),
)

KEV_VENDORS = ("wordpress", "drupal", "joomla", "apache", "nginx", "openssl", "php", "typo3", "craft cms", "tomcat", "litespeed", "mysql",
    "mariadb", "proftpd", "openssh", "iis", "exchange", "magento", "prestashop", "roundcube", "mssql", "sql server")

# port, text in the banner (none: presence alone), technology
PORT_RULES = (
    (3306, "mysql", "mysql"), (21, "proftpd", "proftpd"), (21, "vsftpd", "vsftpd"), (22, "openssh", "openssh"), (3389, None, "rdp"),
    (6379, "redis", "redis"), (9200, "elasticsearch", "elasticsearch"), (11211, "memcached", "memcached"), (2375, None, "docker"),
        (1433, "mssql", "mssql"),
)
# the same for the inventory, first hit wins
INVENTORY = (
    ((3306,), "mysql", "mysql"), ((21,), "proftpd", "proftpd"), ((21,), "vsftpd", "vsftpd"), ((21,), None, "ftp"),
    ((22,), "openssh", "openssh"), ((22,), None, "ssh"), ((25, 587), None, "smtp"), ((6379,), "redis", "redis"),
    ((9200,), "elasticsearch", "elasticsearch"), ((11211,), None, "memcached"), ((2375,), None, "docker"),
    ((6443,), None, "kubernetes"), ((5900,), None, "vnc"), ((1433,), "mssql", "mssql"),
)

KEY_OIDS = {"1.2.840.113549.1.1.1": "RSA", "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448"}
KEY_SIZES = {"1.3.101.112": 256, "1.3.101.113": 448}
EC_OID, CURVES = "1.2.840.10045.2.1", {"1.2.840.10045.3.1.7": ("P-256", 256), "1.3.132.0.34": ("P-384", 384),
    "1.3.132.0.35": ("P-521", 521)}
SIGNATURE_OIDS = {
    "1.2.840.113549.1.1.11": "SHA256withRSA", "1.2.840.113549.1.1.12": "SHA384withRSA", "1.2.840.113549.1.1.13": "SHA512withRSA",
    "1.2.840.10045.4.3.2": "SHA256withECDSA", "1.2.840.10045.4.3.3": "SHA384withECDSA", "1.2.840.10045.4.3.4": "SHA512withECDSA",
    "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448",
}
SCT_OID, TLS_FEATURE_OID = "1.3.6.1.4.1.11129.2.4.2", "1.3.6.1.5.5.7.1.24"

TLS_WORDS = ("certificate", "tls", "ssl", "handshake", "subjectaltname", "not valid for name", "invalid dns name", "cert")
LOOKUP_WORDS = ("failed to lookup", "name or service not known", "nodename nor servname provided", "no such host")

# risk flags -> points
WEIGHTS = {
    "missing_hsts": 10, "missing_csp": 10, "missing_caa": 8, "weak_tls": 10, "cert_expired": 20, "cert_expiring": 15, "no_dnssec": 5,
    "dmarc_weak": 7, "domain_expiring": 5, "exposed_db_port": 10, "exposed_risky_port": 10, "exposed_ftp": 10, "exposed_docker_api": 10,
    "has_critical_cve": 15, "spf_permissive": 7, "no_dkim": 5,
}
DB_PORTS, RISKY_PORTS = (3306, 5432, 6379, 9200, 27017, 11211), (445, 23, 3389, 5900)
