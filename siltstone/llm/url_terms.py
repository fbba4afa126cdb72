"""The default vocabulary of the url filter, as data: terms by topic, and how much each weighs."""

from __future__ import annotations

#: Weight from which one term decides alone; below it several distinct terms have to meet.
STRICT_WEIGHT = 2

#: Fixed values: (topic, weight, terms). Terms are lower-case letters and digits, with dashes inside.
TOPICS = (
    ("sexual", 2, "porn porno pornos pornography xxx xxxx hentai camgirls camsex sexcam sexchat escorts milf nsfw bdsm fetish hardcore-sex"),
    ("sexual", 1, "adult adults sexy sex nude nudes naked erotic erotica escort cams webcam dating hookup hookups singles lingerie fuck"),
    ("gambling", 2, "onlinecasino online-casino sportsbook blackjack-online slot-machines"),
    ("gambling", 1, "casino casinos bet bets betting bookmaker gamble gambling poker slots slot roulette blackjack jackpot lottery lotto bingo wager odds win winner wins"),
    ("pharmacy", 2, "viagra cialis levitra xanax tramadol-online buy-pills"),
    ("pharmacy", 1, "pills pill pharma pharmacy drugstore prescription-free weightloss diet keto steroids supplement cbd"),
    ("piracy", 2, "warez keygen keygens cracked-software nulled"),
    ("piracy", 1, "crack cracks cracked torrent torrents serials serial pirate piracy rapidshare megaupload leaked repack"),
    ("harm", 2, "malware phishing ransomware botnet spyware carding-forum exploit-kit"),
    ("harm", 1, "hack hacks hacked hacking cheats cheat ddos stolen fake counterfeit replica replicas"),
    ("money", 2, "payday-loans getrichquick ponzi"),
    ("money", 1, "loan loans payday credit refinance mortgage forex crypto-signals bitcoin-doubler earn income investment binary-options rich"),
    ("promotion", 2, "spammer link-farm seo-spam doorway"),
    ("promotion", 1, "spam ads ad adserver affiliate affiliates banner clickbait click clicks coupon coupons cheap cheapest discount free freebies giveaway promo sale track tracker tracking popup redirect backlinks seo outlet"),
)


def vocabulary() -> dict[str, int]:
    """Weight of each term; the greatest where a term is listed twice."""
    out: dict[str, int] = {}
    for _, weight, terms in TOPICS:
        for term in terms.split():
            out[term] = max(weight, out.get(term, 0))
    return out
