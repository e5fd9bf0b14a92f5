"""The words, endings and names that the rules on titles, pages and materials compare with, in plain lists."""

# Headings that are no meeting's title, where they are the whole title.
TITLES_ALONE = (
    "開催について", "開催案内", "開催告知", "開催案内等", "開催日", "開催日時", "開催期間", "議事", "資料", "議題", "日時", "場所", "傍聴", "傍聴案内", "傍聴について", "メンバー",
    "議事次第", "配付資料", "配布資料", "配付資料について", "配布資料について", "議事要旨等", "議事次第等", "会議概要", "会議結果", "１開催日時", "１．日", "●日時", "１．日時", "１　開催日時",
    "１ 日時", "１　日時", "１ 場所", "１　場所", "２ 場所", "２　場所", "３ 議題", "３　議題", "出席者", "出席者名簿",
)
# Headings that are none either where they are a part of it.
TITLES_ANYWHERE = (
    "会議資料詳細", "資料詳細", "会議詳細", "トップページ", "ホーム", "配付資料一覧", "政策について", "国立国会図書館インターネット資料収集保存事業（WARP）", "国立国会図書館インターネット資料収集保存事業",
    "会議資料一覧", "審議会・検討会・研究会等", "審議会、検討会、研究会等", "サイトマップ", "お知らせ", "新着情報", "Interim Report", "共同主催国際会議", "議事次第・資料一覧", "配布資料一覧", "覚書等",
    "資料一覧", "配付資料等", "配布資料等", "報道・広報", "関連リンク", "リンク集", "災害への対応", "施策紹介", "最近の話題", "オンライン利用率引上げ", "調査の概要", "御意見・御感想", "ご意見・ご感想",
    "大臣会見記録", "会見記録", "報道官会見記録", "広報印刷物", "個人情報保護について", "開催予定表", "検査方針・研修実績等", "対象者別メニュー", "提供可能となる食品の情報",
    "新型コロナウイルス感染症に関する情報一覧", "感染症に関する情報一覧", "審議会開催予定", "大臣等記者会見", "記者会見", "政策情報（会議・統計等）", "会議・委員会等", "調査の実施について", "問い合わせ先",
    "情報配信サービス", "イベント概要", "セミナーのご案内", "セミナー案内", "公募情報", "意見募集", "パブリックコメント", "傍聴申込", "傍聴申し込み", "議事録・資料等", "ご意見等連絡先",
)
# Short headings that only count alone.
TITLES_SHORT = ("目次", "覚書", "広報")
# Subjects that follow a list number in headings of reports.
NUMBERED_SUBJECTS = ("概要", "趣旨", "経緯", "意見公募", "背景", "諮問事項", "料率検証")
# Standing papers of a body.
STANDING_PAPERS = (
    "設置要綱", "設置要領", "設置根拠", "設置要項", "運営規程", "運営要領", "委員名簿", "構成員名簿", "名簿", "根拠法令", "関係法令", "申し合わせ", "運営規律", "規約", "設置趣旨", "運営方針",
    "構成員", "審議会の構成", "委員会の構成", "の構成", "機構図", "組織図",
)
# Links of the navigation and of public relations.
NAVIGATION = (
    "報道・広報", "広報", "関連リンク", "リンク集", "災害への対応", "施策紹介", "最近の話題", "オンライン利用率引上げ", "調査の依頼方法", "調査の概要", "御意見・御感想", "ご意見・ご感想", "大臣会見記録",
    "会見記録", "報道官会見記録", "広報印刷物", "個人情報保護について", "開催予定表", "検査方針・研修実績等", "対象者別メニュー", "提供可能となる食品の情報", "新型コロナウイルス感染症に関する情報一覧",
    "感染症に関する情報一覧", "審議会開催予定", "大臣等記者会見", "記者会見", "政策情報（会議・統計等）", "会議・委員会等", "パンフレット", "リーフレット", "メールマガジン", "メルマガ", "ポスター",
    "調査の実施について", "問い合わせ先", "情報配信サービス", "イベント概要", "セミナーのご案内", "セミナー案内", "議事録・資料等",
)
# Texts of links that are no meeting's, as the whole name of one.
LINK_TEXTS = (
    "ホーム", "トップ", "トップページ", "トップへ", "トップへ戻る", "目次", "政策について", "組織案内", "プライバシーポリシー", "サイトマップ", "english", "アクセス", "リンク集", "戻る", "前のページへ戻る", "前のページへ",
    "次へ", "閉じる", "メニュー", "サイト内検索", "利用規約", "ご意見・ご要望", "本文へ移動", "フッターへ移動", "page top", "pagetop", "印刷", "印刷する", "文字サイズ", "拡大", "標準", "関連リンク", "施策紹介", "広報印刷物",
    "個人情報保護について", "オンライン利用率引上げ", "検査方針・研修実績等", "開催予定表", "調査の依頼方法", "調査の概要", "対象者別メニュー", "提供可能となる食品の情報", "新型コロナウイルス感染症に関する情報一覧",
    "感染症に関する情報一覧", "御意見・御感想", "ご意見・ご感想", "会見記録", "記者会見", "開催通知", "開催案内", "開催告知", "開催通知等", "開催案内等", "開催告知等", "傍聴案内", "傍聴申込", "傍聴申込み", "傍聴について", "一部訂正",
    "訂正のお知らせ", "正誤表", "２０２６年", "1.経緯",
)
# Texts of controls that are no material.
CONTROLS = (
    "本文へ移動します", "フッターへ移動します", "閉じる", "メニューを閉じる", "メニューを開く", "このページの先頭へ", "前のページへ戻る", "前のページへ", "先頭へ戻る", "ページトップへ", "ページ先頭へ", "PAGE TOP",
    "Page Top", "pagetop", "トップへ", "トップ", "HOME", "Home", "戻る", "印刷", "印刷する", "全ページを印刷する", "コンテンツへスキップ", "標準", "拡大", "文字サイズ", "文字の大きさ", "別ウィンドウで開く",
    "新しいウィンドウで開く", "（別ウィンドウで開く）", "傍聴留意事項", "傍聴申込", "傍聴申込書", "傍聴申込用紙", "傍聴申込様式",
)
# Names of a material that say nothing.
PLAIN_MATERIALS = ("PDF", "pdf", "資料", "ダウンロード", "リンク", "こちら", "配付資料", "配布資料", "別紙", "別添", "添付", "添付資料", "一覧", "詳細", "印刷用", "印刷")
# Names of a link to a page of materials.
MATERIAL_PAGES = (
    "会議資料", "配付資料", "配布資料", "資料一覧", "配付資料一覧", "配布資料一覧", "会議資料一覧", "提出資料 (HTML)", "配付資料 (HTML)", "提出資料", "会議資料ページ", "議事次第・配付資料 (HTML)",
    "配付資料一覧ページ (HTML)", "議事次第・配付資料", "会議資料等", "配付資料等", "配布資料等", "開催案内", "案内", "開催告知",
)
# Endings of documents.
DOCUMENTS = (".pdf", ".docx", ".xlsx", ".doc", ".xls")
FILES = (".pdf", ".zip", ".doc", ".docx", ".xls", ".xlsx")
# Parts of the addresses of index pages; endings; endings of a page or folder of that name.
INDEX_PARTS = (
    "houdou/index.html", "houdou/houdou.html", "press/index.html", "topics/index.html", "news/index.html", "shingi/index.html", "shingikai/index.html", "comittee/kaisai.html", "space/comittee/about.html",
    "indexshingi.html", "newpage_19921.html", "/int/kaisai/kako.html", "menu_sosiki/singi/index.html", "sonota_index.html", "seisakusesaku_index.html", "shingi_index.html", "shingikai_index.html",
    "iinkaisai/iinkaisai.html", "bunkakaisai/bunkakaisai.html", "yusei_kaisai.html", "/kaisai/yusei/", "menu_news/s-news", "b_menu/houdou", "/sitemap/", "base_gijiroku.html", "top_gijiroku.html",
    "bunkakai_index.html", "b_menu/b004.htm", "/kaisai_yotei/", "/202609/260915.html", "shingi/kaisaiyotei",
)
INDEX_ENDS = (
    "/pressrelease", "/pressrelease/", "/houdou_topics", "/houdou_topics/", "/houdou", "/houdou/", "/kaisai.html", "policymeeting/", "policymeeting/index.html", "sitemap", "sitemap/", "sitemap.html", "sitemap.xml",
    "_index.html", "_index.htm", "kaisai_yotei", "kaisai_yotei/index.html", "/kaisai_yotei.html", "/kaisaiyotei", "/kaisaiyotei.html",
)
INDEX_PAGES = ("member", "meibo", "_backno", "backnumber")
# Titles of index pages, as a part and as the whole.
INDEX_TITLES = (
    "覚書等", "覚書", "過去の国際会議", "研究会等一覧へのリンク", "会議資料詳細", "資料詳細", "会議詳細", "検討会等", "審議会等", "政策・審議会等", "省議・審議会等", "政策・審議会等トップへ", "審議会・研究会",
    "議事録・資料等", "目次", "会議開催予定", "開催予定一覧", "パブリックコメントの結果", "意見公募の趣旨", "ご意見等連絡先",
)
INDEX_TITLES_ALONE = ("審議会", "政策・審議会等トップへ", "その他会議", "会議", "委員会", "目次", "<目次>", "議事録・資料等", "政策・審議会", "会議開催予定", "開催予定", "次回開催予定")
# Bodies whose name ends a page's title.
GOVERNMENT = (
    "厚生労働省", "内閣府", "内閣官房", "財務省", "国税庁", "金融庁", "法務省", "出入国在留管理庁", "公安審査委員会", "公安調査庁", "外務省", "文部科学省", "文化庁", "スポーツ庁", "農林水産省", "水産庁", "林野庁",
    "経済産業省", "資源エネルギー庁", "特許庁", "中小企業庁", "国土交通省", "観光庁", "気象庁", "海上保安庁", "環境省", "原子力規制委員会", "防衛省", "防衛装備庁", "デジタル庁", "こども家庭庁", "食品安全委員会",
    "消費者庁", "警察庁", "消防庁",
)
# What tells a notice of a coming meeting: parts of its address, whole titles, parts of titles, and news that is none unless it has a round.
NOTICE_PARTS = ("kaisaiannai", "_annai_", "annai_", "kaisai_yotei", "kaisaiyotei", "/online_kaisai/", "/annai/", "/event/", "/seminar/")
NOTICE_ENDS = ("/annai.html", "/kaisai_annai.html")
NOTICE_TITLES_ALONE = ("会議開催予定", "開催予定", "次回開催予定", "開催案内", "開催通知", "次回開催通知", "開催告知")
NOTICE_TITLE_ENDS = (
    "開催予定について", "開催案内について", "開催通知について", "開催について", "開催告知について", "開催通知", "開催告知", "開催のお知らせについて", "開催案内", "開催のお知らせ", "開催", "傍聴の案内", "傍聴について",
    "傍聴される皆様への留意事項", "の開催概要について", "傍聴の受付", "傍聴申込み", "傍聴申込", "傍聴の申込について", "傍聴の申込みについて", "議事要旨", "議事録", "のご案内", "の案内", "問い合わせ先", "情報配信サービス",
    "取材の案内について", "取材について",
)
# What visitors and the press are told of, and what follows it, as a word of a title by itself.
VISITS, VISIT_ENDS = ("傍聴", "取材"), ("", "の案内", "について", "希望", "申込", "申込み")
NOTICE_TITLES = (
    "開催案内", "開催通知", "開催告知", "会議開催予定", "傍聴される皆様への留意事項", "傍聴留意事項", "傍聴申込", "傍聴の受付", "傍聴の申込", "取材の案内", "取材申込み", "取材申込", "標記の会議について",
    "下記のとおり開催", "以下のとおり開催", "を開催します", "を開催いたします",
)
NOTICE_NEWS = (
    "調査の実施について", "問い合わせ先", "情報配信サービス", "イベント概要", "セミナーのご案内", "指定研修機関の指定等について", "研修内容に関する意見", "基準に関する意見", "一部訂正", "訂正のお知らせ", "正誤表",
    "の公表について", "を公表しました", "を取りまとめました", "とりまとめを公表",
)
# Words by which a title without materials is that of a meeting, and words by which it is none.
MEETING_WORDS = ("部会", "分科会", "委員会", "検討会", "有識者会議", "審議会", "協議会", "ワーキンググループ", "WG", "小委員会", "懇談会", "会議")
OTHER_WORDS = ("調査", "アンケート", "セミナー", "公募", "意見募集", "問い合わせ先", "情報配信サービス")
UNDATED_WORDS = ("現在の会議", "年度", "関連", "ニュース", "利用について", "カメラ")
# Words that admit a news item, and those that reject it.
NEWS_WORDS = ("審議会", "検討会", "部会", "委員会", "懇談会", "ワーキング", "タスクフォース", "分科会", "研究会", "有識者会議", "開催", "配付資料", "議事録", "議事次第")
NEWS_NAVIGATION = ("トップページ", "目次", "プライバシーポリシー", "アクセシビリティ", "リンク集", "免責事項", "採用", "公募")
# A ministry's own hosts, seconds between requests to a host, and the seconds for all others.
MINISTRY_HOSTS = {
    "MHLW": ("mhlw.go.jp",), "METI": ("meti.go.jp",), "MAFF": ("maff.go.jp",), "MOJ": ("moj.go.jp",), "CAO": ("cao.go.jp", "scj.go.jp", "cas.go.jp", "kantei.go.jp"), "CAS": ("cas.go.jp", "kantei.go.jp", "cao.go.jp"),
    "NPA": ("npa.go.jp",), "FSA": ("fsa.go.jp",), "MIC": ("soumu.go.jp",), "MOF": ("mof.go.jp",), "MEXT": ("mext.go.jp",), "MLIT": ("mlit.go.jp",), "MOE": ("env.go.jp",), "MOD": ("mod.go.jp",),
    "DIGITAL": ("digital.go.jp",), "CFA": ("cfa.go.jp",),
}
HOST_SECONDS = {"cas.go.jp": 1.0, "kantei.go.jp": 1.0, "meti.go.jp": 1.5}
OTHER_HOST_SECONDS = 0.5
# Signs of a browser check, and of a page that isn't there (which some stores answer with 403).
BROWSER_CHECKS = ("awswafcookie", "aws-waf", "challenge-error-text", "challenge-running", "cf-browser-verification")
MISSING_PAGES = (
    "指定されたページまたはファイルは存在しません", "指定されたページは見つかりませんでした", "指定されたページは存在しません", "ページが見つかりません", "お探しのページは見つかりませんでした", "nosuchkey", "404 not found",
    "<title>not found</title>",
)
# Characters that file names can't have, and the wide ones in their place.
FILE_SIGNS, FILE_WIDE = '\\/:*?"<>|', "￥／：＊？”＜＞｜"
FILE_KINDS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".zip", ".html", ".htm", ".txt", ".csv")
# Kinds of bodies, in the order in which a title is asked for them, and the mark of each in a round's key.
BODY_MARKS = {
    "アドホック": "アドホック", "サブワーキンググループ": "サブWG", "サブWG": "サブWG", "タスクグループ": "タスクフォース", "タスクフォース": "タスクフォース", "TF": "タスクフォース", "作業班": "作業班", "ワーキンググループ": "WG", "WG": "WG",
    "総会": "総会", "専門小委員会": "専門小委員会", "専門委員会": "専門小委員会", "小委員会": "小委員会", "部会": "部会", "フォローアップ": "フォローアップ会合", "幹事会": "幹事会", "実務者協議会": "実務者協議会",
    "実務者検討委員会": "実務者検討委員会", "協議会": "協議会", "検討会": "検討会", "分科会": "分科会",
}
# Web archives; headings of index pages that are no council; words that name a council.
WEB_ARCHIVES = ("warp.da.ndl.go.jp", "warp.ndl.go.jp")
MINISTRY_NAMES = ("消費者庁", "環境省", "経済産業省", "文部科学省", "厚生労働省", "総務省", "内閣府", "金融庁")
COUNCIL_WORDS = (
    "審議会", "検討会", "委員会", "部会", "分科会", "懇談会", "ワーキンググループ", "WG", "研究会", "プロジェクトチーム", "タスクフォース", "有識者会議", "本部", "推進会議", "円卓会議", "会議", "政策",
)
PUBLIC_HOSTS = (".go.jp", ".or.jp", ".ac.jp")
