"""A small rule set of our own for references to Union law, in the rule language."""

from __future__ import annotations

from functools import cache

from .rules import RuleSet, compile_rules, rules_from_xml

XML = r"""
<rules>
  <rule name="year"><pattern>(?:19|20)\d{2}</pattern></rule>
  <rule name="short_year"><pattern>\d{2}</pattern></rule>
  <rule name="act_label_EN"><pattern>Regulation|Directive|Decision</pattern></rule>
  <rule name="act_label"><pattern>Regulation|Verordnung|Règlement|Directive|Richtlinie|Decision|Beschluss|Décision</pattern></rule>
  <rule name="union"><pattern>\((?:EU|EC|EEC|UE|CE|CEE|EG|EWG|Euratom)\)</pattern></rule>
  <rule type="case" label="Case" order="1" base-type="caselaw">
    <pattern>([CTF])-(\d{1,4})/({{?: short_year }})</pattern>
    <guard-pattern>[CTF]-\d</guard-pattern>
    <view target="eurlex" default="1" label="to case" environment="*">&lt;a data-celex="6{{ $3|year }}{{ $1 }}J{{ $2|pad:'0':4 }}" href="https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:6{{ $3|year }}{{ $1 }}J{{ $2|pad:'0':4 }}"&gt;</view>
    <view target="table">{{ $1|upper }}-{{ $2 }}/{{ $3 }}</view>
  </rule>
  <rule type="oj" label="Official Journal" order="2">
    <pattern>OJ\s([LC])\s(\d+),\s(\d{1,2})\.(\d{1,2})\.(\d{4})</pattern>
    <guard-pattern>OJ\s[LC]</guard-pattern>
    <view target="eurlex" default="1" environment="*">&lt;a data-oj="JO_{{ $1 }}_{{ $5 }}_{{ $2|pad:'0':3 }}" href="https://eur-lex.europa.eu/oj/{{ $1 }}/{{ $5 }}/{{ $2 }}"&gt;</view>
  </rule>
  <rule type="act" label="Act" order="3" base-type="legislation" list-prefix="1" list-shared="2 3">
    <pattern>({{ act_label }})\s{{ union }}\s(?:No\.?\s|Nr\.?\s)?({{ year }})/(\d{1,4})</pattern>
    <guard-pattern>{{ union }}</guard-pattern>
    <view target="eurlex" default="1" environment="eurlex cellar" condition="$1 == 'Regulation'">&lt;a data-celex="3{{ $2 }}R{{ $3|pad:'0':4 }}" href="http://data.europa.eu/eli/reg/{{ $2 }}/{{ $3 }}/oj"&gt;</view>
    <view target="eurlex" environment="eurlex cellar" condition="$1 == 'Directive'">&lt;a data-celex="3{{ $2 }}L{{ $3|pad:'0':4 }}" href="http://data.europa.eu/eli/dir/{{ $2 }}/{{ $3 }}/oj"&gt;</view>
    <view target="eurlex" environment="eurlex cellar" condition="$1 == 'Decision'">&lt;a data-celex="3{{ $2 }}D{{ $3|pad:'0':4 }}" href="http://data.europa.eu/eli/dec/{{ $2 }}/{{ $3 }}/oj"&gt;</view>
  </rule>
  <rule type="ecli" label="ECLI" order="4">
    <pattern>ECLI:([A-Z]{2}):([A-Z0-9]+):(\d{4}):([A-Z0-9.]+)</pattern>
    <guard-pattern>ECLI:[A-Z]{2}:[A-Z0-9]+:\d{4}:[A-Z0-9.]+</guard-pattern>
    <view target="curia" default="1">&lt;a data-ecli="ECLI:{{ $1|upper }}:{{ $2|upper }}:{{ $3 }}:{{ $4|upper }}" href="https://e-justice.europa.eu/ecli/ECLI:{{ $1|upper }}:{{ $2|upper }}:{{ $3 }}:{{ $4|upper }}"&gt;</view>
  </rule>
  <rule type="celex" label="CELEX" order="5">
    <pattern>([1-9])({{ year }})([A-Z]{1,2})(\d{4})</pattern>
    <view target="eurlex" default="1">&lt;a data-celex="{{ $1 }}{{ $2 }}{{ $3|upper }}{{ $4 }}" href="https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:{{ $1 }}{{ $2 }}{{ $3|upper }}{{ $4 }}"&gt;</view>
  </rule>
</rules>
"""


@cache
def rule_set(language: str = "EN") -> RuleSet:
    return compile_rules(rules_from_xml(XML), language)
