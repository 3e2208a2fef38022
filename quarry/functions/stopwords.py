"""Short lists of function words, ordered by length."""

from __future__ import annotations

_WORDS = {
    "en": "a i an as at be by do he if in is it me my no of on or so to up us we all and any are but can did for had has her him his how its not now off our out own she the too was who why you been both does down each from have here into just more most only over same some such than that them then they this very were what when will with about above after again being below their there these those under until where which while would because before between through",
    "de": "am an da du er es im in ob so um wo zu als auf aus bei bin bis das dem den der des die ein für hat ich ihm ihn ihr ist man mir mit nun nur sie und uns vom von vor war was wer wie wir zum zur aber alle also auch dann dass dein denn dich doch eine euch habe kein mein nach noch oder sehr sein sich sind über weil wenn wird durch einem einen einer eines haben jetzt keine nicht unter waren werde zwischen",
    "fr": "à y au ce de du en et eu il je la le ma me ne on ou sa se si ta te tu un aux ces des est eux ils les lui mes moi nos pas par que qui ses son sur tes toi ton une vos avec dans elle mais même nous pour sans sont vous cette comme notre votre leurs étaient",
    "es": "a e o y al de el en es la le lo me mi ni no se si su te tu un ya con del era fue hay las les los más muy nos por que qué sin son sus una uno como cual ella ellos entre esta este esto para pero sobre todo también cuando donde desde hasta porque",
    "it": "a e i o ad al da di ed ha ho il in io la le lo ma mi ne se si su ti tu un che chi con del dei gli lei lui nel non per più suo sua sul tra una uno alla come dalla della delle sono anche dove questa questo quando perché",
    "pt": "a e o à ao as às da de do em eu já me na no os ou se um com das dos ela ele foi mas nas nos não por que sem ser seu sua uma como mais para pela pelo quando também entre depois",
    "nl": "u af al de en er ik in is je me na nu of om op te we ze aan als bij dat den der die dit een geen had heb hem het hij hoe kan met men mij nog ons ook tot uit van was wat wie wij zal zij zich zijn naar over door haar deze maar meer niet onder tegen toen voor waren werd worden",
    "sv": "i av de du en er ha han har hon jag kan man med men mig min ni nu när och oss på sig sin som så till upp var vi vid är att den det ett för där efter eller från under utan mycket",
    "da": "af at da de du en er et fra han har hun hvis i ind jeg kan man med men mig min ned når og os på sig sin som til ud var vi vil være det den der efter eller havde ikke under",
    "no": "av da de deg den der det du en er et fra ha han har hun hva i ikke jeg kan man med meg men min nå når og oss på seg sin skal som så til ut var vi vil ved være etter eller under",
    "fi": "ei en et he ja jo me ne on se te hän joka kun kuin mikä minä mutta niin nyt olen oli ovat sinä tai tämä vain että myös ole joku",
    "ru": "а в и к о с у я бы во да до ее за из им их ко ли мы на не ни но ну об он от по со то ты уж вам вас все всё вы где для его еще или как мне над нас нет она они под при про раз так там тем тут чем что это был была были быть если когда меня может только чтобы",
    "tr": "ve ya bu da de ki mi ne o bir çok en her gibi ile için ise kim mı mu mü ama ancak daha değil diye hem hiç kadar sonra şu veya yani",
    "ro": "a al am ar ca cu de din ei el ea eu și în la le lui mai ne nu o pe prin sau se ți un una va care ce dar este fost pentru sunt",
    "hu": "a az be de el és ez ha is itt ki le már még meg mi nem ő ők össze csak egy én fel hogy így kell lesz mert mint ott pedig sem vagy van volt",
    "pl": "a i o u w z że ale co czy dla do go ich jak je jej już mi na nie niż od po się są ta tak to tym we za być był była było jest może oraz przez przy tylko",
    "cs": "a i k o s u v z ale ani asi být co do jak je jeho jej jen již jsem jsou já kdo kde má na ne nebo není od po pod pro před při se si své ta tak ten to tu už ve za že",
    "bg": "а в и к о с у аз без би бъде във да до ето за из има как като ли между ми на не ни но от по под при са се си след със то той тя че ще",
    "ca": "a de el els em en és et i la les li lo me ni no o per que se si són sa un una amb com del dels més molt on però quan sense també",
    "el": "ο η το τα τη της τον των στο στη και κι να με σε για από που πως δεν θα ως αν αλλά μια ένα είναι",
    "eu": "al bat da du edo eta ez ere bi egin izan hau hori dira beste baina zen",
    "fa": "و در به از که این را با است برای آن یک تا هم بر یا اما اگر می شد بود",
    "ar": "في من على إلى عن ما لا هذا هذه أن إن كان كانت هو هي التي الذي و أو ثم لم لن قد كل مع",
    "ckb": "و له بۆ به که ئەم ئەو لە بە من تۆ ئێمە یان",
    "hi": "का की के को में से है हैं और या पर यह वह इस उस ने भी तो ही था थी थे एक नहीं कि जो",
    "hr": "a i u o s k je su se da ne na od do za iz li ali ili kao što koji koja nije biti bio sam si smo ste sve te to taj",
    "hy": "և է են որ այս այդ այն ու ի մեջ համար հետ էր իր չի եմ ես նա",
    "id": "di ke ya itu ini dan yang untuk pada dari dengan atau juga tidak akan oleh adalah ada karena saya kami kita mereka",
    "ga": "a ag an ar as do go i is le na ó sa sé sí agus bhí níl mar nach seo sin tá",
    "gl": "a o e de do da en un unha que con por para non se os as ao á máis como pero tamén",
}
STOP = {k: sorted(set(v.split()), key=lambda w: (len(w), w)) for k, v in _WORDS.items()}
