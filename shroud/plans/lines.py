"""Lines for every detection rule, as SQL over the keys of a table: one that the rule matches and one that just misses.

``{h}``: 32 hexadecimal digits, ``{H}`` the same in capitals, ``{n}``: a number; ``{nl}``, ``{bs}``, ``{q}``: line feed, backslash, quote.
"""

from __future__ import annotations

import re

GUID = "12345678-1234-4234-8234-{h12}"
RULE_LINES = {
    "R01": ("use AKIA{H16} now", "use AKIA{H15} now"),
    "R02": ('aws_secret_access_key = "{h}{h8}"', "aws_secret_access_key = {h15}"),
    "R03": ("aws_session_token={h}", "aws_session_token={h15}"),
    "R04": ("azure_client_secret = {h16}~x", "azure_client_secret = abc"),
    "R05": (f"azure_tenant_id: {GUID}", "azure_tenant_id: 12345678-1234-4234-8234-{h8}"),
    "R06": (f"subscription_id = {GUID}", "subscription_id = 12345678-{h8}"),
    "R07": ("DefaultEndpointsProtocol=https;AccountName=acc{n};AccountKey={h}==;EndpointSuffix=core.windows.net", "DefaultEndpointsProtocol=https;AccountName=acc{n};AccountKey={h}==;EndpointSuffix=core.window.net"),
    "R08": ("get https://acc{n}.blob.host/c?sv=2020&se=2030&sp=r&sr=b&sig={h}%3D", "get https://acc{n}.blob.host/c?sv=2020&se=2030&sr=b&sig={h}%3D"),
    "R09": ("AIza{h}Q_x", "AIza{h}Q"),
    "R10": ('{{"private_key": "-----BEGIN PRIVATE KEY-----{bs}n{h}{bs}n-----END PRIVATE KEY-----{bs}n"}}', '{{"private_key": "-----BEGIN PUBLIC KEY-----{bs}n{h}{bs}n-----END PUBLIC KEY-----{bs}n"}}'),
    "R11": ('"client_email": "svc{n}@proj-abc.iam.gserviceaccount.com"', '"client_email": "svc{n}@proj-abc.iam.service.com"'),
    "R12": ("gho_{h}", "gho_{h15}"),
    "R13": ("github_pat_{h}", "github_pat_{h15}"),
    "R14": ("glpat-{h}", "glpat-{h15}"),
    "R15": ("xoxb-{h16}", "xoxb-{h8}"),
    "R16": ("post https://hooks.slack.com/services/T{H8}/B{H8}/{h}", "post https://hooks.slack.com/services/T{H8}/B{H8}/{h15}"),
    "R17": ("kubeconfig for c{n} token: {h}", "kubeconfig for c{n} token: {h15}"),
    "R18": ("client-key-data: {h}", "client-key-data: {h15}"),
    "R19": ('{{"auths": {{"r{n}": {{"auth": "{h}=="}}', '{{"auths": {{"r{n}": {{"auth": "{h15}"}}'),
    "R20": ("TFE_TOKEN={h16}", "TFE_TOKEN=abc{n1}"),
    "R21": ("terraform vars for n{n} client_secret = {h16}", "terraform vars for n{n} client_secret = ab{n1}"),
    "R22": ("-----BEGIN EC PRIVATE KEY-----{nl}{h}{nl}-----END EC PRIVATE KEY-----", "-----BEGIN EC PUBLIC KEY-----{nl}{h}{nl}"),
    "R23": ("postgres://app:Pq{h8}@db{n}.corp:5432/x", "postgres://db{n}.corp:5432/x"),
    "R24": ("jdbc:sqlserver://db{n}.corp:1433;user=sa;password=Px{h8}", "jdbc:sqlserver://db{n}.corp:1433;user=sa;password=Px{n1}"),
    "R25": ("ftp://bot:Px{h8}@files{n}.corp/a", "ftp://bot@files{n}.corp/a"),
    "R26": ("samaccountname: svc.user{n}", "samaccountname: ab"),
    "R27": ("userPrincipalName=user{n}@corp-mail.io", "userPrincipalName=user{n}"),
    "P01": ("-----BEGIN RSA PRIVATE KEY-----{nl}{h}{nl}-----END RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----{nl}{h}"),
    "P02": ("-----BEGIN OPENSSH PRIVATE KEY-----{nl}{h}{nl}-----END OPENSSH PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----{nl}{h}"),
    "P03": ("-----BEGIN CERTIFICATE-----{nl}{h}{nl}-----END CERTIFICATE-----", "-----BEGIN certificate-----{nl}{h}"),
    "P04": ("see [PWM_3].{h8} now", "see [PWM_3] now"),
    "P05": ("AWS_SECRET_ACCESS_KEY={h}{h8}", "AWS_SECRET_ACCESS_KEY={h}"),
    "P06": ("AWS_SESSION_TOKEN={h}", "AWS_SESSION_TOKEN={h16}"),
    "P07": ("AWS_ACCESS_KEY_ID={H16}", "AWS_ACCESS_KEY_ID={H8}"),
    "P08": ("old AKIA{H16}.", "old AKIB{H16}."),
    "P09": ("AZURE_STORAGE_ACCOUNT_KEY={h}{h8}==", "AZURE_STORAGE_ACCOUNT_KEY={h}"),
    "P10": ("TWILIO_AUTH_TOKEN={h}", "TWILIO_AUTH_TOKEN={h15}"),
    "P11": ("DD_APP_KEY={h}{h8}", "DD_APP_KEY={h}"),
    "P12": ("sk-live-{h16}", "sk-live-{h8}"),
    "P13": ("sk-ant-api03-{h}", "sk-ant-{h15}"),
    "P14": ("new github_pat_{h}", "new github_pat-{h}"),
    "P15": ("xapp-{h}", "xapp-{h15}"),
    "P16": ("hook https://hooks.slack.com/services/T{H8}/B{H8}/{h}", "hook http://hooks.slack.com/services/T{H8}/B{H8}/{h}"),
    "P17": ("https://discord.com/api/webhooks/12345678901234567/{h}", "https://discord.com/api/webhooks/123456/{h}"),
    "P18": ("ghs_{h}", "ghx_{h}"),
    "P19": ("glrt-{h}", "glxx-{h}"),
    "P20": ("eyJ{h8}.{h16}.{h16}", "eyJ{h8}.{h16}"),
    "P21": ("sk_live_{h16}", "sk_live_{h8}"),
    "P22": ("whsec_{h16}", "whsec_{h8}"),
    "P23": ("key AIza{h}-_Z", "key AIza{h15}"),
    "P24": ("GOCSPX-{h}", "GOCSPX-{h15}"),
    "P25": ("refresh_token=1//{h}", "refresh_token=2//{h}"),
    "P26": ("SG.{h16}.{h}", "SG.{h15}.{h}"),
    "P27": ('{{"api_key": "{h}"}}', '{{"api_key": "ab{n1}"}}'),
    "P28": ('{{"dbPassword": "Pw{h8}!"}}', '{{"dbPassword": "Pw{n1}!"}}'),
    "P29": ('{{"accessToken": "{h}"}}', '{{"accessToken": "ab{n1}"}}'),
    "P30": ('{{"clientSecret": "{h}"}}', '{{"clientSecret": "ab{n1}"}}'),
    "P31": ("<db_password>Px{h8}!</db_password>", "<db_password>Px{h8}!</db_passwort>"),
    "P32": ("my api key is {h}", "my api key is ab{n1}"),
    "P33": ("our openai key: {h}", "our openai key: ab{n1}"),
    "P34": ("the password is Px{h8}", "the password is Px{n1}"),
    "P35": ('our secret is "Qx {h8}!"', 'our secret is "quiet words"'),
    "P36": ("password -> Px{h8}", "password -> Px{n1}"),
    "P37": ("key: sk-proj-{h16}", "key: sk-proj-{h8}"),
    "P38": ("real value is Rv{h8}", "real value is Rv{n1}"),
    "P39": ('secret "Sv{h8}"', 'secret "Sv{n1}"'),
    "P40": ("our token: Tk{h8}", "our token: Tk{n1}"),
    "P41": ('x "private_key": "-----BEGIN PRIVATE KEY-----{bs}n{h}{bs}n-----END PRIVATE KEY-----{bs}n"', 'x "private_key": "{h}"'),
    "P42": ("authorization: bearer {h}", "authorization: bearer ab{n1}"),
    "P43": ("bearer {h}", "bearer ab{n1}"),
    "P44": ("BASIC_AUTH=Basic {h}==", "BASIC_AUTH=Basic {h15}"),
    "P45": ("mongodb+srv://db{n}.corp/x", "mongo://db{n}.corp/x"),
    "P46": ("sftp://u{n}:Px{h8}@h{n}.corp", "sftp://u{n}@h{n}.corp"),
    "P47": ("Endpoint=sb://ns{n}.host/;SharedAccessKeyName=root;SharedAccessKey={h}", "Endpoint=sb://ns{n}.host/;SharedAccessKeyName=root"),
    "P48": ("DefaultEndpointsProtocol=https;AccountName=a{n};AccountKey={h};EndpointSuffix=other.net", "DefaultEndpointsProtocol=https;AccountName=a{n};AccountKey={h}"),
    "P49": ("npm_{h}abcd", "npm_{h}"),
    "P50": ("pypi-{h}{h8}", "pypi-{h}"),
    "P51": ('"auth": "{h}=="', '"auth": "{h15}"'),
    "P52": ("Set-Cookie: sid={h}", "Set-Cookie: sid={h15}"),
    "P53": ("https://a{n}.corp/x?api_key={h}", "https://a{n}.corp/x?api_key=ab{n1}"),
    "P54": ("https://a{n}.corp/x?y=1&token={h}", "https://a{n}.corp/x?y=1&token=ab{n1}"),
}
LINES = [t for pair in RULE_LINES.values() for t in pair]
_PARTS = {"h": "h", "H": "UPPER(h)", "n": "n", "nl": "CHR(10)", "bs": "CHR(92)", "q": "CHR(39)", "{": "CHR(123)", "}": "CHR(125)"}


def line_sql(template: str) -> str:
    """The template as SQL over columns h and n, both strings."""
    out = []
    for plain, mark in re.findall(r"([^{}]*)(\{\{|\}\}|\{[A-Za-z]+\d*\}|$)", template):
        if plain:
            out.append(f"'{plain}'")
        if mark:
            name = mark[0] if mark in ("{{", "}}") else mark[1:-1]
            base, size = re.fullmatch(r"([A-Za-z{}]+)(\d*)", name).groups()
            out.append(f"SUBSTR({_PARTS[base]}, 1, {size})" if size else _PARTS[base])
    return f"CONCAT({', '.join(out)})"


def lines_view(templates: list[str], table: str = "orders", key: str = "o_orderkey", group: str = "o_custkey") -> str:
    """doc_id, session_id, seq, text: a line for each row of the table, templates in turn."""
    cases = " ".join(f"WHEN {k} THEN {line_sql(t)}" for k, t in enumerate(templates))
    return f"SELECT doc_id, session_id, doc_id AS seq, CASE doc_id % {len(templates)} {cases} END AS text FROM (SELECT {key} AS doc_id, CONCAT('s', CAST({group} % 97 AS STRING)) AS session_id, MD5(CAST({key} AS STRING)) AS h, CAST({group} AS STRING) AS n FROM {table})"


#: Two lines for each detector of values that are scored: one that is kept, one that isn't.
SCORED_LINES = [
    "api_token: Bearer {h16}zQ", "view?token= Bearer abc", "login_email = user{n}@corp-mail.io", "user_name: 12345", '{{"username": "jane.roe{n}"}}', '{{"username": "[PWM_3]"}}', "Harbor{n}!Stone7q", "plain words in a row",
    "net 10.{n2}.0.0/16 up", "net 11.{n2}.0.0/16 up", "host 192.168.4.{n1} ok", "host 192.0.2.{n1} ok", "file share FS1234567 moved", "part FS1234567 moved", "group AD123-SH456-FILE-L-STFSA1234567R", "group AD123-SH456-FILE-X-STFSA1234567R",
    "azure rg-prod-weu-app-{n2} created", "the rg-hello-world thing", "vnet-prod-weu-hub-{n2} peering", "db-hello-world", "storage account stweuprodfiles{n1}01", "a strongword", "server srv-app-prod-{n2} in subnet", "the x-y-{n1} value",
    "owner CORP{bs}jane.roe{n1}", "uses svc-backup in a service", "login by svc-backup-{n1}", "see module.name here", "openstack ecs-prod-eu-de-{n2} flavor", "as-hello-world", "project_id: {h}", "project_id: {h15}", "to b{n1}.obs.eu-de.otc.t-systems.com", "to b{n1}.example.org",
]
