"""The vocabulary of urls on lists of both kinds, made by hand: what it lets through and what it blocks by mistake."""

from __future__ import annotations

from marketweave.llm import urls

BAD = """best-casino.com/bonus casino.org/ poker-online.net/free-bonus bet.example.org/free/live/win/prizes play-slots.com/free spielautomaten.de/ wetten.de/bonus/gratis apuestas.es/bonus paris-sportifs.fr/bonus/gratuit xxx.com/watch free-porn.org/ sexkontakte.de/ sexe-gratuit.fr/rencontres hot-girls.org/cams/live adult.org/dating
pills.net/buy/cheap/online buy-viagra.org/ sans-ordonnance.fr/ rezeptfrei-kaufen.de/pillen pharmacy.io/cheap/pills warez.ru/ get.org/crack/serial torrent.to/download iptv.me/free/apk payday-loans.com/now forex.io/earn/money/fast crypto.biz/free/cash/win followers.shop/buy/cheap/fast buy-backlinks.com/ replica.shop/buy
loteria.es/ganar kredite.de/sofort/kostenlos prestamos.es/rapido/online dating.com/singles/free escorts.com/now clickbait.com/win/prizes hack.org/cheats free.org/proxy/hack/download bingo.uk/bonus%2Fwin gambling.com/best""".split()
GOOD = """shop.com/sale/deals med.org/research/cancer-drugs/weight tv.org/watch/live/stream/free paper.com/crypto/investment car.org/escort-vehicles uni.edu/forex-trading essex.ac.uk/ sussex.org/sexton middlesex.edu/adult-education math.org/slotsky news.org/casinoland-closes zeitung.de/kredit-fuer-studenten bank.de/kredite/haus lemonde.fr/acheter/maison
paris.fr/sportifs/paris hospital.org/pills-and-patients gov.uk/gambling-commission/report nih.gov/drugs/detox-research kino.de/kostenlos/live docs.org/proxy/configuration blog.org/best/free/online/chat store.com/buy/order/now vinos.es/comprar/barato wiki.org/Poker gift.com/offers/free/secret/tricks museum.org/nude-in-art apk.org/tools
security.org/hack-week chess.com/win/fast cooking.org/hot/cheap/deal game.com/download/mp3/free travel.fr/gratuit/gagner school.org/prize-giving scunthorpe.uk/ analytics.io/traffic therapist.org/rapist library.org/serials cracks-in-concrete.org/ followersoftheway.org/ bookbets.example/ theatre.org/singles-night""".split()


def test_errors_of_both_kinds():
    automaton = urls.vocabulary(urls.weights())
    missed = [u for u in BAD if not urls.judged("https://" + u, automaton)]
    wrong = [u for u in GOOD if urls.judged("https://" + u, automaton)]
    assert (missed, wrong) == ([], [])
    assert len(BAD) == 40 and len(GOOD) == 41 and len(urls.weights()) <= 200


def test_lures_alone_reject_nothing():
    automaton = urls.vocabulary(urls.weights())
    assert not urls.judged("https://x.org/" + "/".join(urls.SOFT[urls.SUBJECT - 1]), automaton)
    assert urls.judged("https://x.org/free/now/bet", automaton) and not urls.judged("https://x.org/free/bet/free", automaton)
