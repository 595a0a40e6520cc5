"""The built-in vulnerability catalogue (technology, id, severity, CVSS, first and last affected version, summary)."""

SEED = (
    ("wordpress", "CVE-2023-2745", "HIGH", 8.8, "6.0", "6.2.9", "WordPress core authenticated stored XSS via block editor"),
    ("wordpress", "CVE-2022-21661", "HIGH", 8.8, "5.6", "5.8.3", "WordPress SQL injection via WP_Query"),
    ("wordpress", "CVE-2021-44223", "CRITICAL", 9.8, "0", "5.8", "WordPress Gutenberg plugin arbitrary file upload"),
    ("wordpress", "CVE-2019-17671", "HIGH", 7.5, "0", "5.2.3", "WordPress unauthenticated view of private posts"),
    ("drupal", "CVE-2018-7600", "CRITICAL", 9.8, "7.0", "8.5.1", "Drupalgeddon2 — remote code execution"),
    ("drupal", "CVE-2018-7602", "CRITICAL", 9.8, "7.0", "7.59", "Drupalgeddon2 SA-CORE-2018-004 follow-up"),
    ("drupal", "CVE-2019-6340", "CRITICAL", 9.8, "8.6", "8.6.9", "Drupal REST API remote code execution"),
    ("joomla", "CVE-2023-23752", "MEDIUM", 5.3, "4.0.0", "4.2.7", "Joomla improper API access leading to info disclosure"),
    ("joomla", "CVE-2015-8562", "CRITICAL", 9.8, "1.5", "3.4.5", "Joomla PHP object injection via session data"),
    ("joomla", "CVE-2017-8917", "CRITICAL", 9.8, "3.7.0", "3.7.0", "Joomla SQL injection in com_fields"),
    ("apache", "CVE-2021-41773", "CRITICAL", 9.8, "2.4.49", "2.4.49", "Apache HTTP Server path traversal and RCE"),
    ("apache", "CVE-2021-42013", "CRITICAL", 9.8, "2.4.49", "2.4.50", "Apache HTTP Server path traversal follow-up"),
    ("apache", "CVE-2017-7679", "CRITICAL", 9.8, "2.2.0", "2.2.32", "Apache mod_mime buffer overread"),
    ("apache", "CVE-2022-31813", "HIGH", 7.5, "2.4.0", "2.4.53", "Apache HTTP Server request smuggling"),
    ("nginx", "CVE-2021-23017", "HIGH", 7.7, "0.6.18", "1.20.0", "nginx DNS resolver off-by-one heap write"),
    ("nginx", "CVE-2019-9511", "HIGH", 7.5, "1.0.7", "1.17.2", "nginx HTTP/2 DoS (Data Dribble attack)"),
    ("nginx", "CVE-2019-9513", "HIGH", 7.5, "1.0.7", "1.17.2", "nginx HTTP/2 DoS (Resource Loop attack)"),
    ("php", "CVE-2023-3824", "CRITICAL", 9.8, "8.0.0", "8.1.22", "PHP buffer overread in PHAR parsing"),
    ("php", "CVE-2022-31628", "HIGH", 7.8, "7.4.0", "8.1.11", "PHP phar wrapper stack buffer overflow"),
    ("php", "CVE-2021-21706", "MEDIUM", 4.3, "5.3.0", "7.4.25", "PHP ZipArchive::extractTo path traversal"),
    ("php", "CVE-2019-11043", "CRITICAL", 9.8, "7.1.0", "7.3.10", "PHP-FPM buffer underflow in env_path_info"),
    ("typo3", "CVE-2023-24814", "CRITICAL", 9.8, "9.0.0", "12.1.1", "TYPO3 SQL injection in page tree"),
    ("typo3", "CVE-2022-36020", "HIGH", 8.8, "9.0.0", "11.5.16", "TYPO3 improper access control in backend"),
    ("typo3", "CVE-2019-12747", "CRITICAL", 8.8, "8.0.0", "9.5.7", "TYPO3 Extbase deserialization attack"),
    ("openssl", "CVE-2022-0778", "HIGH", 7.5, "1.0.2", "3.0.1", "OpenSSL BN_mod_sqrt infinite loop DoS"),
    ("openssl", "CVE-2022-3602", "HIGH", 7.5, "3.0.0", "3.0.6", "OpenSSL X.509 punycode buffer overflow"),
    ("openssl", "CVE-2014-0160", "HIGH", 7.5, "1.0.1", "1.0.1f", "Heartbleed — OpenSSL memory disclosure"),
    ("craft cms", "CVE-2024-56145", "CRITICAL", 9.8, "3.0.0", "5.5.2", "Craft CMS code injection via template rendering"),
    ("craft cms", "CVE-2025-23209", "HIGH", 8.8, "4.0.0", "5.5.5", "Craft CMS code injection via improper input validation"),
    ("craft cms", "CVE-2025-35939", "HIGH", 8.0, "3.0.0", "5.6.2", "Craft CMS external control of assumed-immutable web parameter"),
    ("litespeed", "CVE-2022-0073", "HIGH", 8.8, "5.0", "6.0.12", "LiteSpeed Web Server privilege escalation via dashboard"),
    ("litespeed", "CVE-2022-0074", "HIGH", 8.8, "5.0", "6.0.12", "LiteSpeed Web Server RCE via log injection"),
    ("litespeed", "CVE-2020-36641", "CRITICAL", 9.8, "5.0", "5.4.12", "LiteSpeed Cache Plugin path traversal"),
    ("tomcat", "CVE-2025-24813", "CRITICAL", 9.8, "9.0.0", "11.0.2", "Apache Tomcat path equivalence RCE"),
    ("tomcat", "CVE-2020-1938", "CRITICAL", 9.8, "7.0.0", "9.0.30", "Apache Tomcat AJP Ghostcat file read/inclusion"),
    ("tomcat", "CVE-2017-12617", "HIGH", 8.1, "7.0.0", "9.0.1", "Apache Tomcat JSP upload via HTTP PUT"),
    ("tomcat", "CVE-2016-8735", "CRITICAL", 9.8, "6.0.0", "9.0.0", "Apache Tomcat RCE via JMX listener"),
    ("mysql", "CVE-2016-6662", "CRITICAL", 9.8, "0", "5.7.15", "MySQL/MariaDB config file injection leading to RCE as root"),
    ("mysql", "CVE-2016-6664", "HIGH", 7.0, "0", "5.7.15", "MySQL/MariaDB privilege escalation via unsafe file handling"),
    ("mysql", "CVE-2012-2122", "HIGH", 7.5, "0", "5.6.5", "MySQL auth bypass via timing attack on memcmp"),
    ("mysql", "CVE-2023-21980", "CRITICAL", 9.8, "8.0.0", "8.0.32", "MySQL optimizer RCE"),
    ("mssql", "CVE-2022-23276", "HIGH", 8.8, "15.0.0", "15.0.4197", "SQL Server 2019 on Linux container elevation of privilege"),
    ("mssql", "CVE-2020-0618", "HIGH", 8.8, "0", "14.0.9999", "SQL Server Reporting Services deserialization RCE"),
    ("mssql", "CVE-2019-1068", "HIGH", 8.8, "0", "15.0.2000", "SQL Server Machine Learning Services remote code execution"),
    ("mssql", "CVE-2018-8273", "CRITICAL", 9.8, "0", "14.0.3030", "SQL Server 2016/2017 buffer overflow via crafted request"),
    ("mssql", "CVE-2021-1636", "HIGH", 8.8, "0", "15.0.4102", "SQL Server remote code execution via linked server"),
    ("proftpd", "CVE-2015-3306", "CRITICAL", 10.0, "0", "1.3.5", "ProFTPD mod_copy unauthenticated arbitrary file read/write"),
    ("proftpd", "CVE-2019-12815", "CRITICAL", 9.8, "0", "1.3.6b", "ProFTPD mod_copy arbitrary file copy without auth"),
    ("proftpd", "CVE-2011-4130", "CRITICAL", 9.0, "0", "1.3.3g", "ProFTPD use-after-free in response pool"),
    ("vsftpd", "CVE-2011-2523", "CRITICAL", 10.0, "2.3.4", "2.3.4", "vsftpd 2.3.4 backdoor command execution"),
    ("rdp", "CVE-2019-0708", "CRITICAL", 9.8, "0", "999", "BlueKeep — pre-auth wormable RCE in Windows RDP (KEV)"),
    ("rdp", "CVE-2019-1181", "CRITICAL", 9.8, "0", "999", "DejaBlue — pre-auth RCE in Windows RDP (KEV)"),
    ("rdp", "CVE-2019-1182", "CRITICAL", 9.8, "0", "999", "DejaBlue variant — pre-auth RCE in Windows RDP (KEV)"),
    ("redis", "CVE-2022-0543", "CRITICAL", 10.0, "0", "6.2.6", "Redis Lua sandbox escape RCE via Debian/Ubuntu package"),
    ("redis", "CVE-2021-32761", "HIGH", 7.5, "2.2.0", "6.2.5", "Redis integer overflow in GETDEL/COPY leading to heap corruption"),
    ("redis", "CVE-2023-28425", "MEDIUM", 5.5, "0", "7.0.10", "Redis malformed LMPOP command crash"),
    ("redis", "CVE-2023-41056", "HIGH", 8.1, "7.0.0", "7.2.3", "Redis integer overflow in listTypeSetTypeAt heap corruption"),
    ("elasticsearch", "CVE-2014-3120", "CRITICAL", 9.8, "0", "1.3.0", "Elasticsearch Groovy sandbox escape leading to RCE"),
    ("elasticsearch", "CVE-2015-1427", "CRITICAL", 9.8, "0", "1.4.2", "Elasticsearch Groovy/MVEL sandbox escape RCE"),
    ("elasticsearch", "CVE-2021-22145", "MEDIUM", 6.5, "7.0.0", "7.13.3", "Elasticsearch sensitive info disclosure via error reporting"),
    ("memcached", "CVE-2021-37519", "HIGH", 7.5, "0", "1.6.9", "Memcached heap buffer overflow in binary protocol"),
    ("memcached", "CVE-2022-48571", "HIGH", 7.5, "0", "1.6.17", "Memcached NULL pointer dereference in UDP stats command"),
    ("memcached", "CVE-2016-8705", "CRITICAL", 9.8, "0", "1.4.33", "Memcached SASL auth multiple integer overflows leading to RCE"),
    ("docker", "CVE-2024-41110", "CRITICAL", 10.0, "0", "27.1.0", "Docker Engine AuthZ plugin bypass allowing unauthenticated API RCE"),
    ("docker", "CVE-2019-13139", "HIGH", 8.4, "0", "18.9.3", "Docker build command injection via malicious Dockerfile"),
    ("openssh", "CVE-2024-6387", "HIGH", 8.1, "8.5p1", "9.7p1", "regreSSHion — OpenSSH unauthenticated RCE via race in SIGALRM handler (KEV)"),
    ("openssh", "CVE-2023-38408", "CRITICAL", 9.8, "0", "9.3p1", "OpenSSH ssh-agent forwarding RCE via remote library loading"),
    ("openssh", "CVE-2023-51385", "MEDIUM", 6.5, "0", "9.6", "OpenSSH OS command injection via shell metacharacters in host or username"),
    ("iis", "CVE-2017-7269", "CRITICAL", 9.8, "6.0", "6.0", "Microsoft IIS 6.0 WebDAV buffer overflow RCE"),
    ("iis", "CVE-2015-1635", "CRITICAL", 9.8, "7.5", "8.5", "Microsoft IIS HTTP.sys remote code execution"),
    ("iis", "CVE-2021-31166", "CRITICAL", 9.8, "10.0", "10.0", "Microsoft IIS HTTP Protocol Stack RCE"),
    ("exchange", "CVE-2021-26855", "CRITICAL", 9.8, "15.0.0", "15.2.792", "Microsoft Exchange Server SSRF leading to pre-auth RCE (ProxyLogon, KEV)"),
    ("exchange", "CVE-2021-34473", "CRITICAL", 9.8, "15.0.0", "15.2.858", "Microsoft Exchange Server remote code execution (ProxyShell, KEV)"),
    ("exchange", "CVE-2022-41082", "HIGH", 8.8, "15.0.0", "15.2.1118", "Microsoft Exchange Server remote code execution (ProxyNotShell, KEV)"),
    ("magento", "CVE-2022-24086", "CRITICAL", 9.8, "2.3.0", "2.4.2", "Magento/Adobe Commerce pre-auth RCE via template injection (KEV)"),
    ("magento", "CVE-2022-24087", "CRITICAL", 9.8, "2.3.0", "2.4.2", "Magento/Adobe Commerce pre-auth RCE follow-up (KEV)"),
    ("magento", "CVE-2025-24434", "CRITICAL", 9.1, "2.4.0", "2.4.7", "Magento/Adobe Commerce authorization bypass allowing code read/execution"),
    ("prestashop", "CVE-2023-30839", "CRITICAL", 10.0, "0", "8.0.4", "PrestaShop SQL injection via crafted HTTP request body"),
    ("prestashop", "CVE-2022-36408", "HIGH", 7.2, "0", "1.7.8", "PrestaShop SQL injection via BO invoice module"),
    ("roundcube", "CVE-2023-5631", "HIGH", 8.8, "0", "1.6.3", "Roundcube stored XSS via HTML-formatted email (KEV)"),
    ("roundcube", "CVE-2023-43770", "MEDIUM", 6.1, "0", "1.4.14", "Roundcube XSS via plaintext email linkreference"),
    ("roundcube", "CVE-2024-37383", "MEDIUM", 6.1, "0", "1.5.7", "Roundcube XSS via SVG animate attributes in HTML email"),
)
