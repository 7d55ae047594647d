"""Common function words of the six languages of the corpus."""

from __future__ import annotations

FUNCTION_WORDS: dict[str, str] = {
    "en": "a about above after again against all although among an and any are as at be because been before being between both but by can could did do does during each every few for from had has have he her his how if in into is it its many may more most no nor not of off on once one only or other our out over own same she should so some still such than that the their them then there these they this those through to too under until up very was we were what when where which while who why will with within without would you your",
    "de": "aber alle als am an auch auf aus bei beim bis da damit dann das dass dem den denn der des die dies diese diesem diesen dieser dieses doch du durch ein eine einem einen einer eines er es für gegen hat haben hatte hinter ich ihm ihn ihr ihre im in ins ist jede jedem jeden jeder jedoch kein keine man mehr mit nach nicht noch nun nur ob oder ohne schon sehr sein seine seit sich sie sind so über um und uns unter vom von vor war waren was wegen weil wenn werden wie wir wird wo wurde wurden zu zum zur zwar zwischen",
    "fr": "a à ainsi alors après au aucun aussi autre aux avant avec avoir bien car ce ceci cela celle celui ces cet cette ceux chaque chez comme contre d dans de depuis des dès donc dont du elle elles en encore entre est et été être eux fait il ils je jusqu l la le les leur leurs lors lui mais me même mes moins mon n ne ni non nos notre nous on ont ou où par pas pendant peu plus pour pourquoi qu quand que quel quelle qui s sa sans se selon ses si son sont sous sur tandis tous tout toute toutes très tu un une vers vos votre vous y",
    "es": "a al algo algunas algunos ante antes aquel así aún aunque cada como con contra cual cuando de del desde donde dos durante e el él ella ellas ellos en entre era es esa ese eso esta está estas este esto estos fue ha han hasta hay la las le les lo los mas más me mientras mi muy ni no nos o os otra otro para pero poco por porque pues que qué se según ser si sí sin sobre solo son su sus también tan tanto te tiene todo todos tras tu un una uno unos y ya yo",
    "it": "a ad agli ai al all alla alle allo anche ancora avere c che chi ci come con contro così cui d da dagli dai dal dall dalla dalle dallo degli dei del dell della delle dello dentro di dopo dove due durante e è ed era fra gli ha hanno i il in io l la le lei lo loro lui ma me mentre mi molto ne né negli nei nel nell nella nelle nello no noi non nostro o ogni per perché però più poi poco prima qua quale quando quanto quella quello questa queste questi questo qui se secondo sei senza si sia siamo sono sopra sotto su sua sugli sui sul sull sulla sulle suo suoi tra tu tutte tutti tutto un una uno vi voi",
    "pt": "a à ainda ao aos apenas após aquela aquele as às até cada com como contra da das de dela dele depois desde do dos durante e é ela elas ele eles em embora enquanto entre era essa esse esta está este eu foi há isso isto já la lhe mais mas me mesmo meu muito na nas nem no nos nós não num numa o onde os ou outra outro para pela pelas pelo pelos pois por porque pouco quais qual quando que quem se segundo sem sendo ser seu seus só sob sobre sua suas também tão tem todas todo todos um uma umas uns",
}


def function_words() -> frozenset[str]:
    """The words of all languages together."""
    return frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
