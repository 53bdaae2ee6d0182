"""Word lists and patterns of the voters on abusive, hateful or sexual content (fixed values, from general knowledge).

Words are in lower case; plurals in -s and -es are added by rule. A voter's patterns are the alternatives of a tuple; each is
run only on segments that hold one of its necessary words (cues.py).
"""


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


#: Nouns that insult whoever they are said of.
STRONG = """
asshole arsehole shithead bastard dumbass scumbag motherfucker fucker cunt bitch whore slut wanker prick twat dickhead
fuckwit cocksucker douchebag jackass shitbag fuckface dipshit dumbfuck retard faggot tosser bellend jerk pisshead
douche asshat fuckhead fucktard shitstain shitface arsewipe asswipe numbnuts knobhead dickwad prat plonker minger skank hoe
""".split()
#: Nouns that insult a person but have plain uses too.
SOFT = """
idiot moron imbecile loser clown parasite pig rat worm snake weasel cretin fool halfwit nitwit dimwit dunce buffoon
donkey maggot leech scum filth trash garbage coward liar freak pervert creep muppet crook simpleton degenerate lowlife
swine dog cow toad ape dumdum dummy dolt nincompoop ignoramus airhead bonehead blockhead numbskull meathead birdbrain dullard
disgrace rodent vermin cockroach roach slob hag crone tramp sissy snowflake savage animal brute monkey gorilla sicko psycho
lunatic nutcase nutjob wimp pansy thug vulture hyena
""".split()
ADJECTIVES = """
stupid brainless spineless gutless pathetic worthless filthy greasy drooling crooked useless dumb disgusting clueless
miserable ugly rotten stinking vile slimy mindless hopeless idiotic moronic lazy dirty rancid sniveling snivelling
witless senseless toothless clownish cowardly pitiful smelly repulsive revolting braindead retarded ignorant dimwitted
fucking goddamn shitty crappy inbred laughable illiterate
""".split()
#: What groups are called in contempt.
DEHUMANIZING = """
vermin rats cockroaches roaches savages subhumans subhuman filth animals plague parasites scum pigs apes monkeys dogs insects
maggots leeches beasts barbarians degenerates trash garbage criminals thieves disease cancer virus pest pests lice fleas worms
snakes swine hyenas locusts rodents mongrels brutes rapists terrorists crooks liars cheats scroungers freeloaders dirt sewage
""".split()
GROUPS = """
women men girls females immigrants migrants foreigners refugees jews muslims christians hindus blacks whites asians gays
lesbians queers cripples pensioners gypsies arabs mexicans africans natives peasants believers islanders folk people
sikhs buddhists atheists catholics protestants turks indians pakistanis chinese russians poles roma homosexuals trannies
transgenders wives mothers boomers teenagers indigenous aborigines outsiders newcomers strangers settlers tribesmen
""".split()
SEXUAL = """
nudes nude tits titties boobs pussy dick cock cocks cum horny porn porno pornography xxx blowjob handjob orgasm orgy milf
anal fuck fucking fucked suck sucking lick licking spank screw bang hump naked moaning dripping undress strip kneel wet
erotic slutty threesome hardcore amateur singles cams ass arse busty bend panties thong nipples penis vagina clit dildo
masturbate escort escorts hooker hookers sexting sexy topless creampie gangbang bondage fetish webcam camgirl
""".split()
VIOLENT = """
kill stab shoot strangle smash stomp break burn hang lynch lynched gas gassed shot hanged beaten slaughter murder bullet
knife coffin scream beg bleed rope bash crush skull teeth legs knees neck jaw ribs head grave die rot choke gut hunt find
executed exterminated deported throat bleach razor poison noose corpse blood torch dead death fingers bones behead
""".split()
#: Abuse in other languages; a hit needs one of them.
FOREIGN = """
arschloch wichser hurensohn fotze schlampe trottel penner fresse missgeburt drecksau spast vollidiot abschaum ungeziefer
schwuchtel hure kanake untermenschen dreckiges gesindel pack drecksschwein miststück dummkopf schwachkopf hirnlos hirnloser
verreckt verrecke verrecken krepier krepiert schweinehund arschgeige vollpfosten spasti nutte scheißkerl dreckskerl blödmann
connard connasse salope pute putain encule enculé crétin gueule merde salaud batard bâtard racaille bouffon ordure pd
abruti abrutie débile trouduc ducon raclure enfoiré enfoirée pouffiasse vermine crève bougnoule nique
puta puto mierda gilipollas cabrón cabron pendejo maricón imbécil zorra malparido escoria ratas plaga coño idiota hijueputa
mueras muérete muerete gusano gusanos asqueroso asquerosa estúpido estupido tarado subnormal pajero perra chinga cerdo imbécile
caralho porra foder fode viado vadia otário imbecil nojento desgraçado babaca cuzão arrombado verme lixo ratos merda corno
porco nojenta idiotas canalha safado piranha burro imunda imundo morra
stronzo puttana coglione vaffanculo bastardo troia cazzo feccia bastarda schifoso schifosa crepa muori zoccola deficiente
klootzak hoer kutwijf teringlijer kankerlijer mongool eikel sukkel tyfus sterf
kurwa chuj pierdol spierdalaj skurwysyn debil zdechnij pizda dziwka
orospu piç siktir geber aptal gerizekalı şerefsiz
сука блядь хуй пизда мудак ублюдок тварь урод дебил мразь гнида сдохни шлюха идиот тупой скотина дерьмо
जाहिल कुत्ते हरामी कमीने मादरचोद
كلب حمار عاهرة شرموطة حقير
씨발 개새끼 병신 쓰레기 꺼져 죽어라
""".split()
#: Abuse in scripts without blanks, found inside the text.
UNSPACED = (
    "傻逼 傻屄 操你妈 他妈的 婊子 去死 滚蛋 废物 贱人 蠢货 混蛋 畜生 杂种 强奸 做爱 死ね 殺す ぶっ殺 クソ野郎 くたばれ ゴミ野郎 クズ野郎 馬鹿野郎 バカ野郎 売女 糞野郎 消えろ ゴキブリ野郎 "
    "白痴 王八蛋 狗东西 人渣 杀了你 弄死你 滚出 臭婊 脑残 智障 不得好死 害虫 蟑螂 傻子 笨蛋 死んで 殺して 殺してやる ゴミども クズども 寄生虫ども 頭おかしい 気持ち悪い 出て行け 追い出せ 크레이지 씨발 개새끼 병신 죽여버"
).split()

_W = r"[\w'’-]+"
_S = _any(STRONG + SOFT + ["piece of shit", "sack of shit", "son of a bitch", "bag of shit", "waste of space"]) + r"(?:s|es)?"
_A = _any(ADJECTIVES)
_X = f"(?:{_S}|{_A})"
_YOU = r"(?:you|u|ya|your|ur|you're|youre|yourself|yourselves)"
_KIN = r"(?:mother|mum|mom|mama|father|dad|wife|husband|sister|brother|kids|children|family|girlfriend|boyfriend|dog|club|office|team|country|tribe|kind)"
#: Said to someone or of someone who writes or is spoken of here.
TARGETED = (
    rf"\b{_YOU}\b(?:\W+{_W}){{0,6}}?\W+{_X}\b",
    rf"\b{_X}\b(?:\W+{_W}){{0,5}}?\W+(?:you|u|yourself|yours)\b",
    rf"\bwho(?:ever|soever)\b.{{0,40}}\b{_X}\b",
    rf"\b(?:the|these|those|all|you) (?:mods?|bulls?|bears?|admins?|moderators?|shorts?|longs?|traders?|posters?|commenters?|analysts?|{_W} holders?) (?:here |there |on here )?(?:is|are|must be|r)\b.{{0,30}}\b{_X}\b",
    rf"\banother (?:{_W} )?(?:post|take|comment|idea|call|thread|rant|opinion|tip)s? (?:from|by) (?:the|this|that|some|our) (?:{_W} )?{_X}\b",
    rf"\b(?:brain|brains|sense|guts|spine|intelligence|wit|honesty|class)\b than (?:this|that|the|a|these|those|you) (?:{_W} )?{_S}\b",
    rf"\b(?:trust|leave it to|only|just|imagine being|typical of|believe|ask) (?:an? |being )?(?:{_W} )?{_X}\b",
    rf"\b(?:this|that|such an?|what an?|one|absolute|total|complete|utter|resident|usual|local|biggest|dumbest) (?:{_A} )?(?:little )?{_S}\b",
    rf"\b(?:he|she|they|this guy|that guy|op|everyone here|everybody here) (?:is|are|must be)\b.{{0,20}}\b{_S}\b",
    rf"\bas {_A} as (?:you|they|him|her|ever)\b",
    rf"\b{_A} (?:and|,) \w+\b.{{0,30}}\b(?:you are|you're|u r|ur)\b",
    rf"\beven (?:your|ur) {_KIN}\b.{{0,40}}\b{_X}\b",
    rf"^(?:\W*{_A})+ (?:little )?{_S}\b\W*$",
)
DISMISSIVE = (
    r"\b(?:fuck|piss|bugger|sod|naff|fuk|eff|jog) off\b",
    r"\bget (?:lost|stuffed|bent|fucked|cancer|out with your \w+)\b",
    r"\bgo (?:to hell|die|fuck|hang|drown|rot|choke|burn|jump off|play in traffic)\b",
    r"\bshut (?:the (?:fuck|hell) |your |ur )?(?:it|up|trap|mouth|face|hole|gob|mouths|pie hole)\b(?! (?:the|for|down|at|by|in|its|a)\b)",
    r"\b(?:cope|cry|whine|moan|seethe|weep|sob) (?:more|harder)\b",
    r"\bno(?:body| one) (?:asked|needs|wants|likes|loves|cares about) (?:for )?(?:you|u|your|ur)\b",
    r"\b(?:eat|suck|lick) (?:shit|my|it|this)\b",
    r"\bfuck (?:you|u|your|yourself|all of you|the lot of you)\b",
    r"\b(?:screw|damn|curse) you\b",
    r"\bdrop dead\b",
    r"^rot\b",
    r"\brot in (?:hell|jail|the ground)\b",
    r"\bburn in hell\b",
    r"\b(?:your|ur) (?:mother|mum|mom|mama)\b",
    r"\b(?:stfu|gtfo|kys|gfy)\b",
    r"\bkiss my (?:ass|arse)\b",
    r"\bgo back to your (?:cave|hole|swamp|sewer|mother|basement)\b",
)
_BODY = r"(?:teeth|legs?|knees?|neck|jaw|ribs|head|skull|face|arms?|fingers|bones|nose|throat|house|car|home|family|kids|windows|eyes|tongue|hands|kneecaps|spine|back|guts)"
_HARM = r"(?:kill|stab|shoot|strangle|smash|stomp|break|burn|hang|hunt|bash|crush|slit|beat|hurt|gut|cut|murder|end|find|get|visit|choke|bury|skin|drown|poison|torture|maim|behead|knife|butcher|bleed|ruin|destroy|rape|break)"
_HARMED = r"(?:lynched|shot|hanged|hung|gassed|stabbed|burned|burnt|strangled|beaten|drowned|executed|exterminated|stoned|skinned|killed|knifed|whipped|flogged|castrated|beheaded|butchered|slaughtered|crucified|tortured|buried|wiped out|put down|run over|run down|put against|thrown off|thrown under|fed to|set on fire|strung up|locked up)"
_END = r"(?:bullets?|knife|rope|noose|beating|coffin|grave|kicking|blood|box|bag|body bag|hospital|wheelchair|ditch|river|morgue|hearse|ground|pain|death)"
THREAT = (
    rf"\b(?:i|we|they|someone|somebody|ill|i'll|gonna|will|should|ought to|let's|lets)\b.{{0,40}}\b{_HARM}\W+(?:\w+\W+)?(?:you|u|your|ur)\b",
    r"\b(?:i|we) know (?:exactly )?where (?:you|u|your)\b",
    rf"\b(?:you|u) (?:deserve|need|get|will get|earned|end up|will end)\b.{{0,14}}\b{_END}\b",
    r"\bwatch your (?:back|step|kids)\b",
    r"\b(?:kill|hang|shoot|drown|burn|off|neck|cut) (?:yourself|urself|yourselves|themselves|himself|herself)\b",
    r"\bgo hang\b",
    rf"\b(?:keep|go on) \w+ing and (?:you|i|we|somebody|someone)\b.{{0,25}}\b(?:{_END}|die|dead|bleed)\b",
    rf"\b(?:should|must|ought to|needs? to|have to|deserves? to) (?:all )?(?:be|get|have been) {_HARMED}\b",
    r"\b(?:should|deserves? to|ought to) (?:all )?(?:die|burn|rot|hang|suffer|choke|drown|bleed)\b",
    r"\b(?:you(?:'re| are)|ur) (?:a )?dead\b",
    r"\b(?:i )?(?:hope|wish|pray) (?:that )?(?:you|u|they|he|she|your|ur|all of you|someone)\b.{0,30}\b(?:die|dies|dead|rot|rots|choke|chokes|burn|burns|drown|suffer|suffers|bleed|crash|crashes|cancer|get hit|gets hit|run over|never wake)\b",
    r"\b(?:next time|when|if|once) i (?:see|meet|find|catch|get) (?:you|u)\b",
    rf"\b(?:smash|break|stomp|bash|crush|kick in|cut|slit|snap|crack|cave in|rip out|knock out)\w* (?:off )?(?:your|ur|his|her|their) {_BODY}\b",
    r"\b(?:burn|blow up|torch|set fire to|poison|bomb|shoot up) (?:down )?(?:your|ur|their|his|her)\b",
    r"\bdo (?:us|everyone|the world|me|humanity) (?:all )?a favou?r\b",
    r"\b(?:swallow|eat|drink|chew|inhale) (?:a |some |the )?(?:razor|bleach|bullet|poison|glass|gun|rope|acid|antifreeze|petrol|gasoline)\w*\b",
    r"\bjump (?:off|under|in front of) (?:a|the|your|some)\b",
    r"\b(?:put|get|take) a bullet\b",
    r"\bmake (?:you|u|them|her|him) (?:bleed|scream|beg|suffer|pay|cry|crawl)\b",
    r"\b(?:you|they) (?:will|'ll|are going to|gonna) (?:all )?(?:die|bleed|burn|suffer|regret|pay for)\b",
    r"\byour (?:days are numbered|time is coming|turn is coming)\b",
    r"\bsleep with (?:one eye open|the fishes)\b",
)
EXPLICIT = (
    r"\b(?:send|show|post|dm|pm|share)\b.{0,12}\b(?:nudes?|tits|boobs|titties|pics of your|pussy|dick|ass|cock|pussies|panties)\b",
    r"\bhorny\b",
    r"\b(?:hot|wet|sexy|naked|nude)\b.{0,8}\b(?:singles|girls|milfs?|teens|babes|chicks|wives|housewives|moms|sluts)\b",
    r"\bxxx\b",
    r"\b(?:hardcore|uncensored|amateur|free|live)\b.{0,14}\b(?:porn|porno|sex|couples|xxx|nudes|camgirls?)\b",
    r"\bporno?\b.{0,30}\b(?:of|link|below|click|team|wife|free|here|video|videos|site)\b",
    r"\b(?:suck|lick|fuck|ride|bang|screw|hump|spank|bend|finger|pound|bone|nail|shag|grope|eat)(?:s|ed|ing)?\W+(?:\w+\W+)?(?:you|u|her|him|me|it|my) (?:\w+ )?(?:all|over|till|until|tonight|hard|here|dry|right|slow|out)\b",
    r"\bbend\b.{0,30}\bover\b",
    r"\b(?:my|his|your|ur) (?:cock|dick|prick|balls|boner|penis)\b",
    r"\b(?:cock|dick)\b.{0,20}\b(?:hard|suck|wet|throbbing)\b",
    r"\bcome suck\b",
    r"\b(?:strip|undress|kneel|crawl|beg|spread|bend|moan|scream)\b.{0,12}\bfor me\b",
    r"\b(?:moaning|dripping|naked|begging|panting|writhing|nude|topless)\b.{0,20}\bon (?:my|his|her|the) (?:bed|desk|lap|floor|sofa|couch|table)\b",
    r"\b(?:ass|arse|tits|boobs|butt)\b.{0,20}\b(?:want|wanna|love|would) to (?:bite|spank|squeeze|slap|grab|lick|touch|ride|eat)\b",
    r"\bi (?:want|wanna|would|will|'d|d)(?: love| like)? (?:to )?(?:fuck|bang|screw|ride|lick|suck|spank|shag|bone|pound)\b",
    r"\b(?:go|goes|going) all the way\b",
    r"\bsuck (?:my|it|me|this)\b",
    r"\bi lick you\b",
    r"\b(?:fuck|suck|ride|lick|bang|shag) (?:you|u|her|him|me)\b",
    r"\b(?:your|her|his) (?:tits|boobs|pussy|ass|arse|nipples|panties)\b",
    r"\b(?:blowjob|handjob|gangbang|creampie|threesome|orgie|orgy|cumshot|deepthroat)s?\b",
    r"\bmasturbat(?:e|es|ed|ing|ion)\b",
)
_G = r"(?:" + "|".join(GROUPS) + r"|old people|young people|disabled people|the (?:poor|disabled|blind|deaf|elderly|old)|[a-z]{3,}ites|[a-z]{4,}(?:ani|avi|oni|ese|ians|ards|ish|vans)|\w+ (?:people|folk|islanders|believers|tribe|tribes))"
_VICE = r"(?:lying|stinking|cheating|stealing|begging|whining|filthy|greedy|lazy|thieving|scheming|dumb|stupid|dirty|smelly|worthless|useless)"
_D = _any(DEHUMANIZING + ["lying", "stinking", "dumb", "lazy", "stupid", "dirty", "too dumb", "too lazy", "inferior", "not human", "not people", "less than human"])
_OUT = r"(?:driven|thrown|beaten|kicked|chased|wiped|burned|hunted|swept|flushed|purged|cleansed|deported)"
CONTEMPT = (
    rf"\b{_G}\b(?:\W+{_W}){{0,6}}?\W+(?:are|r|breed|is|being|were born|all)\b.{{0,30}}\b{_D}\b",
    rf"\b(?:those|these|dirty|filthy|disgusting|stinking|fucking) (?:{_W} )?{_D}\b.{{0,6}}(?:,|the)? ?the {_W}",
    rf"\bget rid of (?:its|the|all|these|those|our|every)\b.{{0,60}}\b{_D}\b",
    r"\b(?:gas|exterminate|deport|lynch|hang|shoot|kill|wipe out|round up|burn|sterilise|sterilize|expel|drown|castrate|lock up) (?:all|every|each|the last|every last)\b.{0,12}\b(?:one|of|them|the)\b",
    r"\bno \w+(?: [\w'’-]+)? in (?:my|our)\b.{0,40}\bthey are\b",
    rf"\btypical {_W}(?: {_W})?\W.{{0,10}}\b{_VICE}\b",
    rf"\b(?:never|don't|dont|do not) (?:let|trust|hire|allow|give|serve)\b.{{0,60}}\bthey(?: are|'re) (?:all )?{_D}",
    rf"\b(?:should|must|ought to|need to|needs to|have to|let them|to) (?:all )?(?:be|get) {_OUT} out of\b",
    r"\bbreed like\b",
    rf"\b(?:is|are|was|were) (?:just )?like (?:\w+ing )?(?:{_W} )?{_D}\b",
    rf"\b{_W}ing (?:{_W} ){{1,3}}is like {_W}ing (?:{_W} )?{_D}\b",
    r"\b(?:send|kick|ship|throw|put|chase) (?:them|those|these|'em) (?:all )?(?:back|out|home|away)\b",
    r"\bout of our (?:town|market|markets|banks?|country|city|schools?|streets?|land|village|neighbou?rhoods?|offices?)\b",
    r"\bevery last one of\b",
    r"\btoo (?:dumb|lazy|stupid|dirty|filthy) to\b",
    rf"\b{_G}\b.{{0,40}}\b(?:belong|belongs) in (?:the kitchen|cages?|a cage|a zoo|the zoo|prison|camps?|the trash|the sewer|the gutter)\b",
    rf"\ball (?:the |these |those )?{_G} (?:should|must|need to|have to) (?:be|go back|leave|die|disappear)\b",
    r"\bgo back to (?:your country|where (?:you|they) came from|africa|mexico|the jungle|the desert)\b",
    rf"\b{_G}\b.{{0,20}}\b(?:ruin|poison|infest|pollute|infect|destroy|contaminate)(?:s|ed|ing)? (?:every|our|this|the whole)\b",
    rf"\b(?:i hate|death to|down with|sick of|fed up with|keep out) (?:all |those |these |the )?(?:{_W} )?{_G}\b",
)
#: Contempt of a foreign-language kind that is spread over words, and threats in those languages.
FOREIGN_PHRASES = (
    r"\b(?:schlag|stech|prügel|brech|bring|mach|tret|schneid|steck)\w* (?:dich|dir|euch)\b",
    r"\b(?:dich|dir|euch) (?:tot|um|kaputt|die|alle)\b",
    r"\bwo du wohnst\b",
    r"\bgeh sterben\b",
    r"\b(?:verreck|krepier|verpiss|fick)(?:e|t|en|st|er)?\b",
    r"\bhalt\b.{0,12}\b(?:fresse|maul|klappe|schnauze)\b",
    r"\b(?:raus|weg) mit (?:den|diesen|denen|allen|dem)\b",
    r"\b(?:sind|seid|ist|bist) (?:doch |nur |ja )?(?:alle |ein |eine |nichts als )?(?:ratten|ungeziefer|abschaum|parasiten|dreck|schädlinge|untermenschen|tiere|schweine|idioten|idiot|schwein|müll|gesindel|pack|affen|trottel)\b",
    r"\b(?:du|ihr) (?:\w+(?:e|er|es|en) )?(?:idiot|idioten|schwein|schweine|sau|hund|ratte|ratten|affe|trottel|versager|penner|arsch)\b",
    r"\bje (?:vais|viens) (?:te|vous|le|la|les)\b.{0,20}\b(?:casser|tuer|saigner|retrouver|crever|égorger|buter|frapper|démolir|défoncer|brûler)",
    r"\b(?:ferme|fermez|ta) (?:ta |vos |ton )?gueule",
    r"\bva (?:te faire|crever|mourir|au diable)\b",
    r"\b(?:son|sont|êtes|es) (?:tous )?(?:de la|des) (?:racaille|vermine|merde|parasites|animaux|rats|cafards|sauvages|chiens|porcs|ordures)\b",
    r"\bfils de\b.{0,8}\bpute\b",
    r"\bsales? (?:arabes?|juifs?|noirs?|pute|chien|chienne|porc|con|conne|crétin|rat|type|bâtard|merde|étrangers?|race|gueule|traître|menteur|idiot|ordure)\b",
    r"\bespèces? de (?:\w+ )?(?:con|conne|connard|connasse|porc|merde|crétin|idiot|imbécile|salaud|salope|chien|débile|abruti|ordure)s?\b",
    r"\b(?:tu es|t'es|vous êtes) (?:qu'un |un |une |des |vraiment )?(?:gros |grosse |sale |pauvre )?(?:con|conne|connard|idiot|idiote|imbécile|porc|merde|minable|nul|débile|abruti|crétin)s?\b",
    r"\b(?:te|os|los|las) (?:voy|vamos) a (?:matar|romper|encontrar|partir|cortar|quemar|reventar|pegar|buscar|rajar|hundir)\w*",
    r"\bvoy a (?:matarte|romperte|encontrarte|partirte|cortarte|quemarte|reventarte|buscarte)",
    r"\bhijos? de (?:la gran )?puta",
    r"\b(?:son|sois|eres|es) (?:unas? |unos )?(?:ratas?|plaga|escoria|basura|parásitos?|animales|cucarachas?|cerdos?|gusanos?|imbécil|idiota|inútil|asco|mierda|bestias|perros?|estúpidos?)\b",
    r"\bhay que (?:echar|matar|expulsar|quemar|eliminar|exterminar|fusilar|colgar)\w*",
    r"\bc[aá]llate\b",
    r"\bpedazo de (?:mierda|basura|imbécil|idiota|animal|inútil|bestia)\b",
    r"\bvete (?:a la (?:mierda|puta|chingada|verga)|al (?:infierno|carajo))\b",
    r"\b(?:ojalá|espero que) (?:te|os|se) (?:mueras?|pudras?|maten|mueran|muráis|atropellen|ahogues)\b",
    r"\bvou te (?:matar|quebrar|achar|pegar|arrebentar|cortar|encontrar|furar|queimar)",
    r"\bvai (?:se|te|tomar no|para o inferno|pro inferno)\b.{0,10}\b(?:foder|cu|fuder|inferno|catar|ferrar)?",
    r"\bcala a boca\b",
    r"\bs[ãa]o (?:uns |umas |todos |todas )?(?:ratos|lixo|vermes|praga|escória|animais|baratas|parasitas|porcos|ladrões|macacos)\b",
    r"\bfora daqui\b",
    r"\bse(?:u|us) (?:\w+ )?(?:nojent|inúte|inútil|imund|idiota|imbecil|burro|porco|verme|lixo|merda|desgraçad|babaca|otári)\w*",
    r"\b(?:tomara|espero) que (?:você|voce|vc|tu|vocês) (?:morra|morram|apodreça|se foda)\b",
    r"\bfilh[oa] da puta",
    r"\bti (?:ammazzo|spacco|uccido|trovo|rompo|sgozzo|brucio)",
    r"\bfigli[oa] di puttana",
    r"\b(?:sei|siete) (?:solo |proprio |tutti )?(?:un[oa]?|dei|delle)? ?(?:stronz|idiot|merd|imbecill|schif|parassit|ratt|cretin|pezz[oi] di)\w*",
    r"\b(?:fai|fate) schifo\b",
    r"\b(?:sono|siete) (?:tutti )?(?:ratti|feccia|parassiti|animali|bestie|vermi|scarafaggi)\b",
    r"\bpezzo di merda\b",
    r"\b(?:rot|flikker) op\b",
    r"\bhou je (?:bek|kop|smoel)\b",
    r"\b(?:jij|je) (?:bent )?(?:een )?(?:vuile|vieze|domme|achterlijke) \w+",
    r"\bja cię (?:zabiję|znajdę)\b",
    r"\bзаткни(?:сь|тесь)\b",
    r"\b(?:я )?тебя (?:убью|найду|зарежу|закопаю)\b",
    r"\bпош[её]л (?:ты|на)\b",
    r"\bsen(?:i|in) (?:öldüreceğim|bulacağım|geberteceğim|ananı)\b",
)
#: Reports about such conduct.
_BODYOF = r"(?:court|judge|jury|tribunal|regulators?|police|prosecutors?|witness|witnesses|union|hearing|panel|lawyers?|lawsuit|complaint|memo|inquiry|report|ombudsman|commission|investigation|employees|staff|magistrates?)"
_CONDUCT = r"(?:harassment|abuse|hate speech|hate|threats?|insults?|slurs?|sexual content|vulgar remarks|vulgar|obscene|obscenity|obscenities|bullying|racism|sexism|misconduct)"
REPORT = (
    rf"\b{_BODYOF}\b.{{0,40}}\b(?:heard|said|says?|found|alleg\w*|ruled|told|cited|described|claims?|called|accus\w*)\b",
    rf"\b{_CONDUCT} (?:claims?|case|hotline|complaints?|policy|suit|lawsuit|training|insult|in a|remarks|on its|cases|allegations?|scandal|charges?|inquiry)\b",
    r"\binsults? in an?\b",
    r"\bhotline\b",
    r"\bpolicy\b.{0,40}\bbans?\b",
    rf"\b(?:bans?|banned|prohibits?|forbids?)\b.{{0,30}}\b{_CONDUCT}\b",
    r"\b(?:had|has|have|was|were|being) (?:been )?(?:called|branded|labelled|labeled) (?:a |an |the )?\w+",
    rf"\bsettle(?:s|d|ment|ments)?\b.{{0,30}}\b(?:claim|suit|case|{_CONDUCT})\b",
    r"\b(?:accused|accuses|accusing)\b",
    r"\bfined\b",
    r"\bsuspended\b.{0,40}\b(?:after|for)\b",
    r"\bsex[- ]ed(?:ucation)?\b",
    r"\bquoted\b",
    r"\bwording\b",
    r"\bapologi[sz](?:ed|es)\b",
    r"\b(?:convicted|sentenced|sued|dismissed|fired|sacked) (?:of|for|over|after)\b",
)
#: Market and trade talk that sounds rough.
_FINANCE = r"(?:margins?|numbers?|quarters?|prints?|gains?|returns?|yields?|tape|prices?|setups?|floats?|charts?|guide|guidance|monday|session|day|leverage|sell-?off|rally|spreads?|puts?|calls?|shorts?|options?|positions?|debentures?|apps?|deals?|market|stocks?|shares?|bonds?|coupons?|assets?|principal|cash|money|subscribers|customers|bounce|cat)"
_BEASTS = r"(?:pigs?|rats?|dogs?|cows?|donkeys?|snakes?|worms?|monkeys?|apes?|toads?|cocks?|bitches|asses|swine|maggots?|leeches|parasites?|insects?|animals?)"
IDIOM = (
    r"\bshort sellers? (?:got|were|was|are)\b",
    rf"\bnaked {_FINANCE}\b",
    rf"\bstrip(?:s|ped|ping)? (?:the |out |of )?(?:tools?|{_FINANCE})\b",
    r"\bdead[- ]cat\b",
    rf"\b(?:killer|sick|ugly|filthy|dirty|nasty|brutal|stupid|dumb|monster|insane|bloody|disgusting|miserable|lazy|crooked|rotten) {_FINANCE}\b",
    r"\bdamn (?:good|fine|well)\b",
    r"\bcrack spreads?\b",
    r"\bbloody\b.{0,20}\b(?:print|monday|session|quarter|leverage|day|\w+ desk)\b",
    r"\bpenetration of\b",
    r"\b(?:hard|soft) guid(?:e|ance)\b",
    r"\bexplicit(?:ly)? (?:about|on)\b",
    r"\b(?:bears|bulls|hawks|doves|shorts|longs) (?:were|got|are|beat|was)\b (?:slaughtered|butchered|killed|crushed|burned|squeezed|the|up)",
    rf"\b(?:breed|farm|rear|feed|herd|rais|trap|slaughter|pack|graz)(?:er|ers|ing|s|ed)? of (?:\w+ ){{0,2}}{_BEASTS}\b",
    rf"\b{_BEASTS}\b.{{0,40}}\b(?:feed|fodder|farm|farms|herd|livestock|shed|barn|vets?|breeders?|pest control)\b",
    rf"\b(?:found|saw|caught|trapped|infested|overrun|traced|because of|over) (?:\w+ )?{_BEASTS}\b|\b{_BEASTS} (?:shut|closed|halted|delayed|in the|at the|near the)\b",
    r"\b(?:maker|seller|supplier|distributor|dealer)s? (?:sells?|sold|ships?|of)\b.{0,40}\b(?:screws?|cocks?|valves?|nuts|tools|bolts|rods)\b",
    r"\b(?:butchering|slaughtering|butchered)\b",
    r"\bbeat the (?:doves|hawks|bears|bulls)\b",
    r"\bdogs? of the\b",
    rf"\b(?:bleed|bleeds|bleeding)\b(?: {_FINANCE})?",
    r"\bcocks for\b",
    r"\b(?:got|getting|were|was) (?:killed|murdered|crushed|slaughtered|burned|hammered|screwed) (?:on|by the|in)\b",
)
#: Remarks about oneself.
SELF = (
    rf"\b(?:i|i'm|im|i am|me|my|myself|mine|we)\b(?:\W+{_W}){{0,5}}?\W+{_X}\b",
    rf"\b(?:my own|how {_A} (?:am|was|of) (?:i|me)|{_A} of (?:me|mine|us)|{_A} me|call me an?)\b",
    rf"\b{_A} (?:trade|move|mistake|idea|decision|bet|call) of (?:mine|ours)\b",
)
