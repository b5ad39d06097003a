"""Detection rules as data, and their compilation into one projection.

Every rule is a boolean column: a process filter, then literals that a match must hold
(cheap ``contains``), then the pattern. Each is evaluated once into an array of the
matching rules; the first gives the verdict, all give tags.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.regex import Pattern, to_java


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    score: int
    outcome: str
    pattern: str
    mitre: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    process: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()  # lower case; a match holds one of them

    @property
    def java(self) -> Pattern:
        return to_java(self.pattern)


def _r(name, category, score, outcome, pattern, mitre="", tags="", process="", hints=""):
    return Rule(name, category, score, outcome, pattern, tuple(mitre.split()), tuple(tags.split()), tuple(process.split()), tuple(hints.split("|")) if hints else ())


# Names, categories, scores, outcomes, patterns, techniques, tags and process filters, first match first.
RULES: tuple[Rule, ...] = (
    _r("reverse_shell_bash_devtcp", "execution", 96, "attempt", r"(?i)(bash|sh|zsh)\s+-i\s*>&?\s*/dev/(tcp|udp)/|nc\s+(-[a-z]*e|--exec)\s", "T1059.004 T1071.001", "reverse-shell リバースシェル c2 遠隔操作", hints="/dev/|nc"),
    _r("curl_pipe_shell", "execution", 88, "attempt", r"(?i)\b(curl|wget)\b[^|;]*\|\s*(sudo\s+)?(ba|z|da)?sh\b", "T1059.004 T1105", "remote-code-execution 任意コード実行 dropper マルウェア配布", hints="curl|wget"),
    _r("cryptominer_indicator", "impact", 92, "success", r"(?i)\b(xmrig|minerd|cpuminer|stratum\+tcp://|nanopool|supportxmr)\b", "T1496", "cryptomining クリプトマイニング resource-hijacking リソース不正利用", hints="xmr|miner|stratum|nanopool"),
    _r("log_tampering", "defense-evasion", 90, "attempt", r"(?i)(rm\s+(-[a-z]+\s+)*/var/log|truncate\s+-s\s*0\s+/var/log|journalctl\s+--vacuum|>\s*/var/log/(auth|sys)log|history\s+-c)", "T1070.002", "anti-forensics 証跡削除 log-tampering ログ改ざん", hints="/var/log|--vacuum|history"),
    _r("ssh_failed_password", "authentication", 46, "failure", r"Failed (?:password|keyboard-interactive/pam|publickey) for (?:invalid user )?(?P<user>[^\s]+) from (?P<ip>[0-9a-fA-F.:]+) port (?P<port>\d+)", "T1110.001", "brute-force ブルートフォース auth-failure 認証失敗 ssh", "sshd", "failed "),
    _r("ssh_invalid_user", "authentication", 52, "failure", r"Invalid user (?P<user>[^\s]*) from (?P<ip>[0-9a-fA-F.:]+)(?: port (?P<port>\d+))?", "T1110.001 T1589.001", "user-enumeration ユーザー列挙 brute-force ブルートフォース ssh", "sshd", "invalid user"),
    _r("ssh_max_auth_attempts", "authentication", 64, "failure", r"(?i)(maximum authentication attempts exceeded|too many authentication failures)", "T1110.001", "brute-force ブルートフォース ssh", "sshd", "authentication"),
    _r("ssh_reverse_dns_mismatch", "reconnaissance", 58, "suspicious", r"POSSIBLE BREAK-IN ATTEMPT", "T1110.001", "spoofing なりすまし break-in 侵入試行", hints="break-in"),
    _r("ssh_accepted_login", "authentication", 26, "success", r"Accepted (?P<method>password|publickey|keyboard-interactive/pam|none) for (?P<user>[^\s]+) from (?P<ip>[0-9a-fA-F.:]+) port (?P<port>\d+)", "T1078.003", "successful-login ログイン成功 valid-accounts 正規アカウント ssh", "sshd", "accepted "),
    _r("ssh_preauth_disconnect", "reconnaissance", 18, "failure", r"(?:Received disconnect from|Connection (?:closed|reset) by(?: authenticating user \S+)?) (?P<ip>[0-9a-fA-F.:]+)(?: port (?P<port>\d+))?.*\[preauth\]", "T1595", "scanning スキャン probe 探索 ssh", "sshd", "[preauth]"),
    _r("pam_authentication_failure", "authentication", 44, "failure", r"pam_unix\([^)]+:auth\): authentication failure;.*?(?:rhost=(?P<ip>[0-9a-fA-F.:]*))?.*?(?:user=(?P<user>\S+))?$", "T1110", "auth-failure 認証失敗 pam", hints="pam_unix("),
    _r("sudo_not_in_sudoers", "privilege-escalation", 72, "failure", r"(?P<user>\S+) : user NOT in sudoers", "T1548.003", "privilege-escalation 権限昇格 sudo policy-violation ポリシー違反", hints="not in sudoers"),
    _r("sudo_incorrect_password", "privilege-escalation", 62, "failure", r"(?P<user>\S+) : \d+ incorrect password attempts?", "T1548.003", "privilege-escalation 権限昇格 sudo auth-failure 認証失敗", hints="incorrect password"),
    _r("sudo_command_executed", "privilege-escalation", 32, "success", r"(?P<user>\S+) : TTY=\S+ ; PWD=\S+ ; USER=(?P<target_user>\S+) ; COMMAND=(?P<command>.+)$", "T1548.003", "sudo 権限昇格 privileged-command 特権コマンド", "sudo", "command="),
    _r("su_failed", "privilege-escalation", 58, "failure", r"FAILED SU \(to (?P<target_user>\S+)\) (?P<user>\S+)", "T1548.003", "privilege-escalation 権限昇格 su auth-failure 認証失敗", hints="failed su"),
    _r("pkexec_polkit_abuse", "privilege-escalation", 86, "attempt", r"(?i)pkexec.*(?:cannot|refus|The value for the SHELL variable was not found|GCONV_PATH)", "T1068", "pwnkit 権限昇格 polkit exploit 脆弱性攻撃 CVE-2021-4034", hints="pkexec"),
    _r("new_user_created", "persistence", 68, "success", r"new user: name=(?P<user>[^,]+), UID=(?P<uid>\d+)", "T1136.001", "persistence 永続化 account-creation アカウント作成", hints="new user:"),
    _r("user_added_to_privileged_group", "persistence", 74, "success", r"add '(?P<user>[^']+)' to group '(?P<group>sudo|admin|wheel|docker|root)'", "T1098", "persistence 永続化 group-membership グループ変更 privilege-escalation 権限昇格", hints="to group"),
    _r("authorized_keys_modified", "persistence", 78, "success", r"(?i)authorized_keys", "T1098.004", "persistence 永続化 ssh-key SSH鍵 backdoor バックドア", hints="authorized_keys"),
    _r("systemd_unit_installed", "persistence", 56, "success", r"(?i)(Created symlink /etc/systemd/system|Reloading|enabled)\b.*\.(service|timer)", "T1543.002", "persistence 永続化 systemd service-install サービス登録", hints=".service|.timer"),
    _r("ufw_block", "network", 30, "blocked", r"\[UFW (?:BLOCK|AUDIT)\].*?SRC=(?P<ip>[0-9a-fA-F.:]+) DST=(?P<dest_ip>[0-9a-fA-F.:]+).*?PROTO=(?P<proto>\S+)(?: SPT=(?P<port>\d+))?(?: DPT=(?P<dest_port>\d+))?", "T1595.001", "firewall-block ファイアウォール遮断 port-scan ポートスキャン", hints="[ufw "),
    _r("iptables_drop", "network", 28, "blocked", r"(?i)IN=\S+ OUT=\S* .*SRC=(?P<ip>[0-9a-fA-F.:]+).*DPT=(?P<dest_port>\d+)", "T1595.001", "firewall-block ファイアウォール遮断", hints="dpt="),
    _r("cron_job_executed", "scheduled-task", 14, "success", r"\((?P<user>[^)]+)\) CMD \((?P<command>.*)\)$", "T1053.003", "cron 定期実行 scheduled-task スケジュールタスク", "CRON cron crond", " cmd ("),
    _r("crontab_modified", "persistence", 60, "success", r"\((?P<user>[^)]+)\) (?:REPLACE|BEGIN EDIT|END EDIT|DELETE) \((?P<target_user>\S+)\)", "T1053.003", "persistence 永続化 cron 定期実行", hints="replace|edit|delete"),
    _r("selinux_apparmor_denied", "policy", 42, "blocked", r'(?i)(avc:\s+denied|apparmor="DENIED")', "T1211", "mandatory-access-control 強制アクセス制御 denied アクセス拒否", hints="denied"),
    _r("auditd_disabled", "defense-evasion", 84, "success", r"(?i)(audit(d)?.*(disabled|stopped|halted)|auditd.*Init complete.*enabled 0)", "T1562.001", "defense-evasion 防御回避 audit-disabled 監査無効化", hints="audit"),
    _r("oom_kill", "system", 54, "failure", r"Out of memory: Kill(?:ed)? process (?P<pid>\d+) \((?P<proc>[^)]+)\)", "T1499.001", "out-of-memory メモリ枯渇 availability 可用性", hints="out of memory"),
    _r("segfault", "system", 46, "failure", r"(?P<proc>\S+)\[(?P<pid>\d+)\]: segfault at (?P<addr>[0-9a-f]+)", "T1499.004", "crash クラッシュ memory-corruption メモリ破壊 possible-exploit 攻撃の可能性", hints="segfault"),
    _r("service_failed", "system", 36, "failure", r"(?i)(Failed to start |entered failed state|Main process exited, code=exited, status=[1-9])", "", "service-failure サービス障害 availability 可用性", hints="failed|exited"),
    _r("disk_error", "system", 50, "failure", r"(?i)(I/O error|SMART error|EXT4-fs error|critical medium error)", "", "hardware ハードウェア disk-error ディスク障害", hints="error"),
    _r("package_change", "configuration-change", 12, "success", r"(?i)\b(apt-get|apt|dpkg|yum|dnf)\b.*\b(install|remove|purge|upgrade)\b", "", "package-management パッケージ管理 change 変更", hints="apt|dpkg|yum|dnf"),
    _r("session_opened", "authentication", 16, "success", r"session opened for user (?P<user>\S+)", "", "session セッション", hints="session opened"),
    _r("session_closed", "authentication", 10, "success", r"session closed for user (?P<user>\S+)", "", "session セッション", hints="session closed"),
)


def folded(text: Column) -> Column:
    """Lower case for literals; the two letters outside ASCII that fold into it count as their ASCII forms."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, "ſK", "sk"))


def process_in(process: Column, names) -> Column:
    return F.lower(process).isin([n.lower() for n in names])


def condition(rule: Rule, message: Column, low: Column, process: Column) -> Column:
    out = message.rlike(rule.java.text)
    if rule.hints:
        hint = low.contains(rule.hints[0])
        for h in rule.hints[1:]:
            hint = hint | low.contains(h)
        out = hint & out
    return process_in(process, rule.process) & out if rule.process else out


def matches(rules, message: Column, low: Column, process: Column) -> Column:
    """The numbers of the rules that match, in order."""
    each = [F.when(condition(r, message, low, process), F.lit(i)).otherwise(-1) for i, r in enumerate(rules)]
    # compiled, which a filter with a lambda isn't, nor all that it rests on
    return F.array_remove(F.array(*each), -1) if each else F.array().cast("array<int>")


def capture(rules, name: str, message: Column, verdict: Column) -> Column:
    """The winning rule's named group, '' if it has none."""
    out = None
    for i, r in enumerate(rules):
        if name in r.java.groups:
            value = F.regexp_extract(message, r.java.text, r.java.group(name))
            out = F.when(verdict == i, value) if out is None else out.when(verdict == i, value)
    return F.lit("") if out is None else out.otherwise("")


def capture_names(rules) -> list[str]:
    return list(dict.fromkeys(g for r in rules for g in r.java.groups if g))
