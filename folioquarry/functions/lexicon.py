"""Word lists by language."""

# Function words that no term begins or ends with.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been before between both but by can could did do does during each even ever few first for from had has have he her here him his how i if in into is it its just later like many may me more most much must my near neither never new no nobody nor not now of off old on once one only or other our out over own same she should since so some such than that the their them then there these they this those through to too two under until up upon very was we were what when where whether which while who whose why will with within without would yet you your".split(),
    "fr": "à afin ai ainsi alors après au aucun aujourd'hui aussi autant autre autres aux avait avant avec bien bref car ce ceci cela celle celles celui ces cet cette ceux chaque ci comme comment contre dans de déjà depuis des deux donc dont du elle elles en encore entre est et était étaient être eu fait faire fut il ils je jamais jusque la là le les leur leurs lors lui mais même mes moi moins mon ne ni non nos notre nous nul on ont or ou où par parce pas pendant peu peut plus plusieurs plutôt pour pourquoi pourtant qu quand que quel quelle qui quoi sa sans se sera ses si sien son sont sous sur surent ta tandis te tel tes toi ton tous tout toute toutes très tu un une vers vite vos votre vous y".split(),
    "de": "ab aber alle allein als also am an ander andere auch auf aus bei bereits bin bis bist da dabei dadurch dafür damit danach dann daran das dass dein dem den denn der des deshalb die dies diese diesem diesen dieser dieses doch dort du durch eher ein eine einem einen einer eines er erst es etwas euch ganz gegen genau gewesen ging hat hatte hatten hier ich ihm ihn ihnen ihr ihre im immer in ins ist ja jede jeder jedes jene kann kein keine konnte lediglich man mehr mein mit nach nicht nichts noch nun nur ob oder ohne schon schwerer sehr sein seine seit sich sie sind so sogar sondern soweit später über um und uns unser unter viel vom von vor war waren warum was weder wenn wer wie wieder wir wird wo wurde zu zuerst zum zur zwischen".split(),
    "es": "a al algo alguno ante antes así aún aunque bien cada casi como con contra cual cuando cuanto de del desde donde dos durante e el él ella ellas ellos en entonces entre era eran es esa ese eso esta está este esto fue fueron ha había hace hacia han hasta hay la las le les lo los más me menos mi mientras mucho muy nada nadie ni no nos nosotros nunca o os otra otro para pero poco por porque pronto pues que qué quien quienes se sea según ser si sí sin sino sobre solo son su sus tal también tampoco tan tanto te todo todos tras tu tus un una uno unos y ya yo".split(),
    "it": "a ad al alla alle anche ancora che chi ci come con contro cui da dal dalla dei del della delle di dove due e ed era essere fra già gli ha hanno i il in io la le lei lo loro lui ma mai me meno mi molto ne nei nel nella no noi non o ogni per perché più poi prima quale quando quella quello questa questo se sempre senza si sia solo sono su sua suo tra tu tutti tutto un una uno".split(),
    "pt": "a ao aos apenas após as assim até com como da das de dela dele depois do dos e é ela ele eles em entre era essa esse esta este eu foi há isso já lhe mais mas me mesmo muito na não nas nem no nos nós o os ou para pela pelo por porque quando que quem se sem ser seu sua também te tem um uma você".split(),
}
ROMAN = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
